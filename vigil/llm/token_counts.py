"""Exact token counts at every prefix of a text, by dynamic programming.

For byte-level BPE every prefix of a pre-token has exactly one encoding, and
that encoding is the encoding of a shorter prefix plus one token that is
compatible with the shorter one's last token. ``PrefixCounter`` therefore keeps
the last token and the count of every prefix and never encodes twice. Distinct
pre-tokens of a slice of documents run through the DP together, position by
position; a text's counts are the sums along its pre-tokens.

``prefix_counts`` returns per document the count steps of all its prefixes
(one signed byte per code point: count(i) - count(i-1)); their running sum
answers any truncation or budget question without re-encoding.

Defined cases: null text counts as empty (0 bytes, 0 tokens, no steps); the
special string ``<|endoftext|>`` is one token wherever it stands whole; repeated
rows and null ids are counted like others; other input columns stay out.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import arrow_map, only, read
from vigil.llm.registry import register
from vigil.llm.words import mix, powers

#: Fixed: the pre-token pattern of byte-level BPE and Unicode white space.
_PRETOKEN = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_CONTRACTIONS = ("'re", "'ve", "'ll")
_WIDE = 32                       # bytes of a run up to which runs are counted together
_LENGTHS = (3, 2, 4, 1, *range(5, _WIDE + 1))
_NONE = 0xFFFFF                  # "no token yet"
_SLOT_BITS = 22
_SLOTS = 1 << _SLOT_BITS
_MEMO = 400_000
_LENGTH = np.uint64(0xC2B2AE3D27D4EB4F)
_POWER, _INVERSE = powers(256)


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Prefix counts of pre-tokens, many at a time: position by position, all
    runs of a batch look for the one token that may end there."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        special = {t["content"] for t in spec["added_tokens"]}
        self.split = regex.compile("(" + "|".join(
            map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.tokens = [raw(t) for t in spec["model"]["vocab"] if t not in special]
        self.id = {t: i for i, t in enumerate(self.tokens)}
        self.rank = {}
        for i, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank[raw(a), raw(b)] = i
        self.longest = max(map(len, self.tokens))
        self.memo: dict[int, bool] = {}
        # keys of the tokens, sorted, behind a bitmap of their top bits
        joined = np.frombuffer(b"".join(self.tokens), np.uint8)
        size = np.array([len(t) for t in self.tokens])
        start = np.cumsum(size) - size
        key = np.zeros(len(size), np.uint64)
        power = _POWER[np.arange(len(joined)) - np.repeat(start, size)]
        np.add.at(key, np.repeat(np.arange(len(size)), size), (joined + np.uint64(1)) * power)
        key = mix(key + size.astype(np.uint64) * _LENGTH)
        self.by_key = np.argsort(key)
        self.keys = key[self.by_key]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[key >> np.uint64(44)] = True
        # direct-mapped answers to "may b follow a?"
        self.pair_key = np.full(_SLOTS, -1, np.int64)
        self.pair_ok = np.zeros(_SLOTS, bool)

    def merge(self, data: bytes) -> list[bytes]:
        """Plain BPE: always the lowest-ranked, leftmost pair."""
        parts = [data[i:i + 1] for i in range(len(data))]
        rank = self.rank.get
        while True:
            best, at = 1 << 60, -1
            for i in range(len(parts) - 1):
                r = rank((parts[i], parts[i + 1]))
                if r is not None and r < best:
                    best, at = r, i
            if at < 0:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def fits(self, key: int) -> bool:
        """Whether token b may follow token a (or start, for a = _NONE)."""
        ok = self.memo.get(key)
        if ok is None:
            a, b = key >> 20, self.tokens[key & 0xFFFFF]
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            ok = self.memo[key] = (self.merge(b) == [b] if a == _NONE else
                                   self.merge(self.tokens[a] + b) == [self.tokens[a], b])
        return ok

    def fit_all(self, key: np.ndarray) -> np.ndarray:
        slot = (mix(key.astype(np.uint64)) >> np.uint64(64 - _SLOT_BITS)).astype(np.int64)
        for i in np.flatnonzero(self.pair_key[slot] != key):
            self.pair_ok[slot[i]], self.pair_key[slot[i]] = self.fits(int(key[i])), key[i]
            # a later key of this batch may take the slot again: answer from the memo
        ok = self.pair_ok[slot]
        for i in np.flatnonzero(self.pair_key[slot] != key):
            ok[i] = self.fits(int(key[i]))
        return ok

    def run_counts(self, run: bytes) -> np.ndarray:
        """Token count after every byte of one (long) pre-token."""
        n = len(run)
        last, count = [_NONE] * (n + 1), np.zeros(n + 1, np.int64)
        for i in range(1, n + 1):
            for j in range(i - 1, max(-1, i - self.longest - 1), -1):
                token = self.id.get(run[j:i])
                if token is not None and self.fits(last[j] << 20 | token):
                    last[i], count[i] = token, count[j] + 1
                    break
        return count[1:]

    def batch_counts(self, runs: list[bytes]) -> np.ndarray:
        """Token count after every byte of each pre-token, joined."""
        size = np.array([len(r) for r in runs], np.int64)
        start = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.int32)
        for i in np.flatnonzero(size > _WIDE):
            out[start[i]:start[i] + size[i]] = self.run_counts(runs[i])
        order = np.argsort(-size, kind="stable")
        order = order[np.searchsorted(-size[order], -_WIDE):]
        if not len(order):
            return out
        size, start = size[order], start[order]  # longest first: those that reach i lead
        joined = np.frombuffer(b"".join(runs), np.uint8).astype(np.uint64) + np.uint64(1)
        m, wide = len(size), int(size[0])
        at = start[:, None] + np.arange(wide)
        prefix = np.zeros((wide + 1, m), np.uint64)
        inside = np.arange(wide) < size[:, None]
        grid = np.where(inside, joined[np.minimum(at, len(joined) - 1)], np.uint64(0)) * _POWER[:wide]
        np.cumsum(grid.T, axis=0, out=prefix[1:])
        last = np.full((wide + 1, m), _NONE, np.int64)
        count = np.zeros((wide + 1, m), np.int32)
        for i in range(1, wide + 1):
            todo = np.arange(int(np.searchsorted(-size, -i, side="right")))
            for n in (x for x in _LENGTHS if x <= i):
                if not len(todo):
                    break
                j = i - n
                key = mix((prefix[i, todo] - prefix[j, todo]) * _INVERSE[j:j + 1] + np.uint64(n * int(_LENGTH) % (1 << 64)))
                some = np.flatnonzero(self.maybe[key >> np.uint64(44)])
                where = np.searchsorted(self.keys, key[some])
                where[where == len(self.keys)] = 0
                some, where = (x[self.keys[where] == key[some]] for x in (some, where))
                rows, token = todo[some], self.by_key[where]
                ok = self.fit_all(last[j, rows] << 20 | token)
                done = rows[ok]
                last[i, done], count[i, done] = token[ok], count[j, done] + 1
                todo = np.delete(todo, some[ok])
        out[at[inside]] = count[1:].T[inside]
        return out

    def texts(self, texts: list[str]) -> list[np.ndarray]:
        """Of each text, the token count after every code point."""
        runs: list[str] = []
        cut = []          # per text: run bounds and special strings' places
        for t in texts:
            first, specials = len(runs), []
            parts = self.split.split(t) if self.split else [t]
            for k, part in enumerate(parts):
                if k % 2:  # a cut special string is ordinary text after what stands before
                    specials.append((first, len(runs), part))
                else:
                    first = len(runs)
                    runs += _PRETOKEN.findall(part)
            cut.append((len(runs), specials))
        code, known = pd.factorize(np.array(runs + [""], object))
        code = code[:-1]
        chars, chars_at, total = self._char_counts(list(known))
        width = np.diff(np.append(chars_at, len(chars)))
        out, at = [], 0
        for (end, specials), text in zip(cut, texts, strict=True):
            pieces, base = [], 0
            for first, stop, special in [*specials, (0, end, "")]:
                got, n = self._joined(code[at:stop], known, chars, chars_at, width, total)
                pieces.append(got + base)
                base += n
                if special:
                    pieces.append(self._cut_special(runs[first:stop], special, base - self._sum(code[first:stop], total)))
                    base += 1
                at = stop
            out.append(np.concatenate(pieces) if pieces else np.zeros(0, np.int64))
            assert len(out[-1]) == len(text)
        return out

    @staticmethod
    def _sum(code, total):
        return int(total[code].sum())

    def _char_counts(self, runs: list[str]):
        """Counts after every code point of each run, joined; their offsets; the totals."""
        data = [r.encode() for r in runs]
        counts = self.batch_counts(data)
        raw = np.frombuffer(b"".join(data), np.uint8)
        ends = np.append((raw[1:] & 0xC0) != 0x80, True) if len(raw) else np.zeros(0, bool)
        chars = counts[ends]
        n = np.array([len(r) for r in runs], np.int64)
        at = np.cumsum(n) - n
        total = np.zeros(len(runs), np.int64)
        total[n > 0] = chars[(at + n - 1)[n > 0]]
        return chars, at, total

    def _joined(self, code, known, chars, chars_at, width, total):
        """Prefix counts of consecutive runs of one segment, and their total."""
        n, t = width[code], total[code]
        before = np.cumsum(t) - t
        first = np.cumsum(n) - n
        got = chars[np.repeat(chars_at[code] - first, n) + np.arange(int(n.sum()))] + np.repeat(before, n)
        # a prefix that ends in white space has that space as one run, and a cut
        # contraction is an apostrophe and a letter
        for k in np.flatnonzero(self._odd(known)[code]) if len(code) else ():
            run = known[code[k]]
            if run in _CONTRACTIONS:
                got[first[k] + 1] = before[k] + sum(int(c[-1]) for c in map(self._one, ("'", run[1])))
            elif run.isspace() and k + 1 < len(code) and known[code[k + 1]][0].isspace():
                got[first[k + 1]] = before[k] + int(self._one(run + known[code[k + 1]][0])[-1])
        return got, int(t.sum())

    def _odd(self, known):
        if getattr(self, "_known", None) is not known:
            self._known = known
            self._odd_runs = np.array([r in _CONTRACTIONS or r.isspace() for r in known], bool)
        return self._odd_runs

    def _one(self, run: str) -> np.ndarray:
        return self._char_counts([run])[0]

    def _cut_special(self, runs: list[str], special: str, base: int) -> np.ndarray:
        """Counts inside a special string that follows ``runs``; ``base``: the
        count before these runs."""
        before = "".join(runs)
        out = []
        for i in range(1, len(special)):
            out.append(base + sum(int(self._one(r)[-1]) for r in _PRETOKEN.findall(before + special[:i])))
        return np.array([*out, base + sum(int(self._one(r)[-1]) for r in runs) + 1])


_counters: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    if path not in _counters:
        _counters[path] = PrefixCounter(path)
    return _counters[path]


#: Text bytes whose distinct pre-tokens are counted together.
SLICE_BYTES = 3 << 20


def prefix_counts(docs: DataFrame, vocabulary: str, budget: int, key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, budget_chars, steps) of every whole text;
    ``budget_chars`` is the longest prefix, in code points, of at most
    ``budget`` tokens. ``vocabulary`` is the tokenizer file's path, the same
    on every machine."""
    src = only(docs, key=key, text="text").withColumn("text", F.coalesce("text", F.lit("")))
    kind = src.schema["key"].dataType.simpleString()

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        c = counter(vocabulary)
        totals, steps, fit = [], [], []
        for counts in c.texts(part.column("text").to_pylist()):
            at = np.flatnonzero(counts <= budget)
            totals.append(int(counts[-1]) if len(counts) else 0)
            steps.append(np.diff(counts, prepend=0).astype(np.int8).tobytes())
            fit.append(int(at[-1]) + 1 if len(at) else 0)
        return pa.RecordBatch.from_arrays(
            [part.column("key"), pa.compute.binary_length(part.column("text")).cast(pa.int64()),
             pa.array(totals, pa.int64()), pa.array(fit, pa.int64()), pa.array(steps, pa.binary())],
            ["key", "n_bytes", "n_tokens", "budget_chars", "steps"])

    out = src.mapInArrow(arrow_map(count, limit=SLICE_BYTES), f"key {kind}, n_bytes long, n_tokens long, "
                                           "budget_chars long, steps binary")
    return out.withColumnRenamed("key", key)


def count_at(counts: DataFrame, chars: str, out: str = "tokens_at") -> DataFrame:
    """Add the exact token count of the first ``chars`` code points."""
    def answer(batches):
        for b in batches:
            got = [None if s is None or n is None else
                   int(np.frombuffer(s, np.int8)[:max(n, 0)].sum(dtype=np.int64))
                   for s, n in zip(b.column("steps").to_pylist(), b.column(chars).to_pylist(), strict=True)]
            yield b.append_column(out, pa.array(got, pa.int64()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in counts.schema)
    return counts.mapInArrow(answer, f"{fields}, `{out}` long")


TOKEN_LIMIT = 512


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents with the 50k byte-level vocabulary."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counted = prefix_counts(read(spark, sf_dir, "documents"), os.fspath(path), TOKEN_LIMIT)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
                          "budget_chars")
