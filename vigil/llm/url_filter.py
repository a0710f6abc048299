"""URL filter over a sorted array of 64-bit xxhash keys.

Rules are (host, path, verdict) prefixes. Their strings ``host + path`` are
hashed with xxh64 (seed 42, as Spark's ``xxhash64``) and sorted. Every prefix
of a URL that could be a rule - each host suffix at a dot, with each path
prefix of a length that some rule has - is looked up by vectorised binary
search in the memory-mapped key array, and a hit counts only if the stored
full string is equal.

Two plans, chosen by the measured size of the rule set: up to
``broadcast_bytes`` the index travels as a broadcast variable and URLs are
probed where they are read; beyond it the distinct URL prefixes meet the index
shard by shard (a shard is a range of hashes) and nothing is broadcast.

Defined cases: a null URL, or one without ``://``, has empty host and path and
fits no rule; rules with a null part are ignored; of equal rules with
different verdicts ``block`` holds; of rules that fit, the longest string
wins, then the longer host; a URL that no rule fits gets ``default``. Repeated
rows are answered once each, and other columns of the input stay out.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import only, read, stored
from vigil.llm.registry import register

#: Fixed rules of the page query: (host, path, verdict).
PAGE_RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"),
              ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
              ("net", "/fr/", "block"))
BROADCAST_BYTES = 32 << 20
_SEED = 42


def url_parts(url: F.Column) -> tuple[F.Column, F.Column]:
    """Host (A-Z lower-cased) and path of a URL column."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(host, upper, upper.lower()), path


def rule_index(rules: DataFrame) -> DataFrame:
    """One row per distinct rule: key (xxh64 of host + path), host, path, verdict."""
    r = only(rules, host="host", path="path", verdict="verdict").dropna()
    return (r.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
            .withColumn("key", F.xxhash64(F.concat("host", "path"))))


def _prefixes(host: str, path: str, lengths: list[int]):
    if not host and not path:
        return
    at = 0
    while True:
        tail = host[at:]
        for n in lengths:
            if n <= len(path):
                yield tail, path[:n]
        at = host.find(".", at) + 1
        if not at:
            return


class SortedKeys:
    """Memory-mapped sorted xxh64 keys with the rules' full strings beside them."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        keys = np.array([xxhash.xxh64_intdigest(h + p, _SEED) for h, p, _ in rules], np.uint64)
        order = np.argsort(keys, kind="stable")
        self.rules = [rules[i] for i in order]
        if not rules:
            self.keys = keys
            return
        with tempfile.NamedTemporaryFile(prefix="urlkeys-") as f:  # unlinked once it is mapped
            f.write(keys[order].tobytes())
            f.flush()
            self.keys = np.memmap(f.name, np.uint64, "r", shape=(len(rules),))

    def find(self, wanted: list[tuple[str, str]]) -> list[str | None]:
        """The verdict of each (host, path) that is a rule, else None."""
        out: list[str | None] = [None] * len(wanted)
        if not len(self.keys) or not wanted:
            return out
        probe = np.array([xxhash.xxh64_intdigest(h + p, _SEED) for h, p in wanted], np.uint64)
        first = np.searchsorted(self.keys, probe)
        hit = np.flatnonzero((first < len(self.keys)) &
                             (self.keys[np.minimum(first, len(self.keys) - 1)] == probe))
        for i in hit:
            k = first[i]
            while k < len(self.keys) and self.keys[k] == probe[i]:  # all that share the digest
                if self.rules[k][:2] == wanted[i]:
                    out[i] = self.rules[k][2]
                    break
                k += 1
        return out


_indexes: dict[str, SortedKeys] = {}


def _local_index(name: str, rules) -> SortedKeys:
    if name not in _indexes:
        _indexes.clear()
        _indexes[name] = SortedKeys(rules)
    return _indexes[name]


def _best(found: list[tuple[str, str, str]]) -> tuple[str | None, str | None]:
    if not found:
        return None, None
    host, path, verdict = max(found, key=lambda r: (len(r[0]) + len(r[1]), len(r[0])))
    return host + path, verdict


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", key: str = "page_id",
               default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES,
               shard_rows: int = 1 << 18) -> DataFrame:
    """Judge every URL: (key, host, path, rule, verdict)."""
    spark = pages.sparkSession
    page = only(pages, key=key, url=url)
    host, path = url_parts(F.col("url"))
    page = page.select("key", host.alias("host"), path.alias("path"))
    index = stored(rule_index(rules), "url-rules")
    size = index.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("host") + F.octet_length("path") + 48),
                                              F.lit(0))).first()
    lengths = sorted(r[0] for r in index.select(F.length("path")).distinct().collect())
    if size[1] <= broadcast_bytes:
        ruled = _probe_broadcast(spark, page, index, lengths)
    else:
        ruled = _probe_shards(page, index, lengths, max(1, size[0] // shard_rows + 1))
    return ruled.select(F.col("key").alias(key), "host", "path", "rule",
                        F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _probe_broadcast(spark, page, index, lengths):
    rules = sorted((r.host, r.path, r.verdict) for r in index.select("host", "path", "verdict").collect())
    sent = spark.sparkContext.broadcast(rules)
    name = f"{spark.sparkContext.applicationId}-{sent._jbroadcast.id() if sent._jbroadcast else id(sent)}"
    kind = page.schema["key"].dataType.simpleString()

    def probe(batches):
        keys = _local_index(name, sent.value)
        for b in batches:
            urls = list(zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True))
            wanted, owner = [], []
            for i, (h, p) in enumerate(urls):
                for w in _prefixes(h, p, lengths):
                    wanted.append(w)
                    owner.append(i)
            found: dict[int, list] = {}
            for i, w, v in zip(owner, wanted, keys.find(wanted), strict=True):
                if v is not None:
                    found.setdefault(i, []).append((*w, v))
            best = [_best(found.get(i, [])) for i in range(len(urls))]
            yield pa.RecordBatch.from_arrays(
                [b.column("key"), b.column("host"), b.column("path"),
                 pa.array([r for r, _ in best], pa.string()), pa.array([v for _, v in best], pa.string())],
                ["key", "host", "path", "rule", "verdict"])

    return page.mapInArrow(probe, f"key {kind}, host string, path string, rule string, verdict string")


def _probe_shards(page, index, lengths, shards):
    def expand(batches):
        for b in batches:
            rows = [(h, p, *w) for h, p in zip(b.column("host").to_pylist(), b.column("path").to_pylist(),
                                               strict=True) for w in _prefixes(h, p, lengths)]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols],
                                             ["host", "path", "h", "p"])

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        keys = SortedKeys(list(zip(right["host"], right["path"], right["verdict"], strict=True)))
        verdict = keys.find(list(zip(left["h"], left["p"], strict=True)))
        out = left[["h", "p"]].assign(verdict=verdict)
        return out[out["verdict"].notna()]

    shard = lambda key: F.pmod(key, F.lit(shards)).cast("int")
    urls = page.select("host", "path").distinct()
    pairs = urls.mapInArrow(expand, "host string, path string, h string, p string")
    probes = pairs.select("h", "p").distinct().withColumn("shard", shard(F.xxhash64(F.concat("h", "p"))))
    hits = (probes.groupBy("shard").cogroup(index.withColumn("shard", shard(F.col("key"))).groupBy("shard"))
            .applyInPandas(search, "h string, p string, verdict string"))
    length = F.struct(F.length("h") + F.length("p"), F.length("h"), F.concat("h", "p").alias("rule"), "verdict")
    best = (pairs.join(hits, ["h", "p"]).groupBy("host", "path").agg(F.max(length).alias("best"))
            .select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict")))
    return page.join(best, ["host", "path"], "left").select("key", "host", "path", "rule", "verdict")


_SQL = """
WITH r AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
           FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
j AS (SELECT *, CASE
   WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
   WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
   WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
   WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
   WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM p)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM j
"""


@register("op2_url_filter", _SQL)
def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL against the fixed page rules."""
    rules = spark.createDataFrame(list(PAGE_RULES), "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages"), rules)
