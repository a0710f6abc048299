"""Operators on single texts against brute force, the library or round trips."""

import hashlib
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from corpus_fixtures import make, prose  # noqa: F401  (fixtures)
from tokenizers import Tokenizer

from vigil.llm import fingerprints, licenses, mixing, pii, token_counts, toxicity, url_filter

VOCABULARY = os.fspath(public_tokenizers.path("byte_bpe_50k.json"))


# ---------------------------------------------------------------- fingerprints
def paragraphs(t):
    return {x for x in re.split(r"\n+|(?<=[.!?])[ \t\r]+", t or "") if x}


def jaccard(a, b):
    a, b = paragraphs(a), paragraphs(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_fingerprints(make):
    rng = random.Random(2)
    texts = ["\n".join(prose(rng, 5) + "." for _ in range(rng.randint(1, 60))) for _ in range(18)]
    texts += [texts[0], "", None, "one line", "\n".join(prose(rng, 4) for _ in range(1500)), "é" * 50]
    rows = {r.doc_id: r for r in fingerprints.fingerprints(make(texts)).collect()}
    ids = sorted(rows, reverse=True)
    assert ids == list(range(len(texts)))[::-1]
    for at, i in enumerate(ids):
        own, following = texts[i] or "", texts[ids[(at + 1) % len(ids)]] or ""
        cut = len(own) // 3
        edited = own[:len(own) - cut] + following[:cut]
        r = rows[i]
        assert r.n_chars == len(own)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.near_edited == pytest.approx(jaccard(own, edited))
        assert r.near_next == pytest.approx(jaccard(own, following))
    assert rows[0].fingerprint == rows[18].fingerprint
    assert len({r.fingerprint for r in rows.values()}) == len(set(t or "" for t in texts))


def test_fingerprints_odd_rows(make):
    got = fingerprints.fingerprints(make([(1, "a. b"), (1, "a. b"), (1, "c"), (None, "d")])).collect()
    assert sorted((r.doc_id or -1, r.n_chars) for r in got) == [(-1, 1), (1, 1), (1, 4), (1, 4)]
    assert fingerprints.fingerprints(make([])).count() == 0
    lone = fingerprints.fingerprints(make([(4, "abc")])).first()
    assert lone.near_next == 1.0 and lone.edited_sha256 == hashlib.sha256(b"aba").hexdigest()


def test_peeling_recovers_differences(spark):
    """Sketches alone, through the larger ones, give the exact differences."""
    rng = random.Random(4)
    rows = []
    for n, m, common in ((0, 0, 0), (3, 0, 0), (5, 4, 9), (40, 60, 10), (900, 1, 300), (0, 0, 500)):
        a = [f"a{rng.random()}" for _ in range(n)]
        b = [f"b{rng.random()}" for _ in range(m)]
        c = [f"c{rng.random()}" for _ in range(common)]
        rows.append(("\n".join(a + c), "\n".join(c + b), n, m))
    df = spark.createDataFrame(rows, "x string, y string, n int, m int")
    from pyspark.sql import functions as F
    df = fingerprints._held(df, a=fingerprints.digests(F.col("x")), b=fingerprints.digests(F.col("y")))
    df = fingerprints._held(df, c=fingerprints.subtract(fingerprints.sketch(F.col("a")), fingerprints.sketch(F.col("b"))))
    for r in fingerprints._held(df, d=fingerprints.difference(F.col("a"), F.col("b"), F.col("c"))).collect():
        assert (r.d.left, r.d.right) == (r.n, r.m)


# ---------------------------------------------------------------- url filter
URLS = ["https://www.Example.com/en/1?x", "http://example.com/en/", "http://EXAMPLE.com/fr/#a", "//a/b", None, "",
        "x://net/es/1", "x://a.net/fr/", "x://anet/fr/", "http://a.b.example.com:80/en/x", "http://com", "ftp://com/",
        "http://notexample.com/en/", "http://x.www.example.com/en/y", "http://a.com?/en/", "http://é.net/fr/ü"]


def brute_url(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h) + len(p), h + p, v) for h, p, v in rules
           if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[1], max(fit)[2]) if fit else (host, path, None, "allow")


@pytest.mark.parametrize("bound", [url_filter.BROADCAST_BYTES, 0])
def test_url_filter(spark, bound):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS)] + [(0, URLS[0], "h", "p")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string")
    rules = spark.createDataFrame([*url_filter.PAGE_RULES, (None, "/", "block")], "host string, path string, verdict string")
    got = sorted((r.page_id, r.host, r.path, r.rule, r.verdict) for r in
                 url_filter.judge_urls(pages, rules, broadcast_bytes=bound, shard_rows=2).collect())
    assert got == sorted((i, *brute_url(u, url_filter.PAGE_RULES)) for i, u, *_ in rows)
    assert url_filter.judge_urls(pages.limit(0), rules, broadcast_bytes=bound).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0), broadcast_bytes=bound).collect()} == {"allow"}


def test_sorted_keys_confirm_strings(monkeypatch):
    """Colliding digests are told apart by the stored strings."""
    monkeypatch.setattr(url_filter.xxhash, "xxh64_intdigest", lambda s, seed: len(s))
    keys = url_filter.SortedKeys([("a", "/", "allow"), ("b", "/", "block")])
    assert keys.find([("b", "/"), ("a", "/"), ("c", "/"), ("long", "/")]) == ["block", "allow", None, None]


# ---------------------------------------------------------------- token counts
TEXTS = ["", None, " ", "  a", "don't we'll 'l '", "x<|endoftext|>y <|endoftext|>", "a\n\n\nb  \n c", "héé 🙂🙂 12 34a",
         "a  'll  'v  b'", "\x1c\x1d a\x85b\u3000\u3000c", "'" * 70 + "ll  " + "x're" * 30, "word" * 200, "<|endof", "Ω≈ç√∫˜µ≤",
         "tab\tand  spaces   end   "]


def test_token_counts_at_every_prefix():
    t, c = Tokenizer.from_file(VOCABULARY), token_counts.counter(VOCABULARY)
    for text, counts in zip(TEXTS, c.texts([t or "" for t in TEXTS]), strict=True):
        text = text or ""
        assert len(counts) == len(text)
        for i in {*range(1, min(len(text), 120) + 1), len(text)} - {0}:
            assert counts[i - 1] == len(t.encode(text[:i], add_special_tokens=False).ids), (text, i)


def test_token_counts_rows(make):
    rng = random.Random(6)
    texts = [*TEXTS, prose(rng, 4000), prose(rng, 300)]
    t = Tokenizer.from_file(VOCABULARY)
    counts = token_counts.prefix_counts(make(texts), VOCABULARY, 50)
    rows = {r.doc_id: r for r in counts.collect()}
    for i, text in enumerate(texts):
        text = text or ""
        assert rows[i].n_bytes == len(text.encode())
        assert rows[i].n_tokens == len(t.encode(text, add_special_tokens=False).ids)
        at = [n for n in range(1, len(text) + 1) if len(t.encode(text[:n], add_special_tokens=False).ids) <= 50] \
            if len(text) < 1000 else None
        assert at is None or rows[i].budget_chars == max(at, default=0)
    from pyspark.sql import functions as F
    some = token_counts.count_at(counts.withColumn("c", F.lit(7)), "c").collect()
    assert all(r.tokens_at == len(t.encode((texts[r.doc_id] or "")[:7], add_special_tokens=False).ids) for r in some)


# ---------------------------------------------------------------- licences
def test_licenses(spark):
    files = [(1, "/a/LICENSE", "Foo\nReleased under the MIT License.\nbar"), (2, "/a/b/c.py", "x = 1"),
             (3, "/a/b/d.py", "# Licensed under the Apache License, Version 2.0. More words"), (4, "/z/e.py", "all"),
             (5, "/a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
             (6, "/q/f.py", None), (7, None, "Licensed under CC BY-NC 4.0."), (8, "/a/x/y/z/g.py", ""), (2, "/a/b/c.py", "x = 1"),
             (9, "/a2/h.py", "licence plates are rare"), (10, "r/LICENSE", "All rights reserved.")]
    df = spark.createDataFrame([(*f, "k") for f in files], "doc_id long, path string, text string, key string")
    got = sorted(((r.doc_id, r.own_license, r.license, r.inherited_from) for r in licenses.scan(df).collect()), key=str)
    assert got == sorted([(1, "MIT", "MIT", None), (2, None, "GPL-3.0", "/a/b"), (2, None, "GPL-3.0", "/a/b"),
                          (3, "Apache-2.0", "Apache-2.0", None), (4, None, None, None), (5, "GPL-3.0", "GPL-3.0", None),
                          (6, None, None, None), (7, "CC-BY-NC-4.0", "CC-BY-NC-4.0", None), (8, None, "MIT", "/a"),
                          (9, None, None, None), (10, "Proprietary", "Proprietary", None)], key=str)
    assert licenses.scan(df.limit(0)).count() == 0


def test_license_of_common_words_at_any_size(spark):
    """Words that many notices have weigh little, template words or not."""
    rows = [(k, f"/p/{k}.py", "Everything within our project is released under the MIT License.") for k in range(600)]
    rows += [(1000 + k, f"/q/{k}.py", f"Everything within our project part{k} x{k}y z{k} has copyright by owner{k}")
             for k in range(2400)]
    df = spark.createDataFrame(rows, "doc_id long, path string, text string")
    got = {r.doc_id: r.own_license for r in licenses.scan(df).collect()}
    assert all(got[k] == "MIT" for k in range(600)) and not any(got[1000 + k] for k in range(2400))


# ---------------------------------------------------------------- personal data
SAMPLES = [("email", "anna.b+x@mail8.example.com"), ("phone", "+1 (988) 555-2485"), ("ip", "42.144.35.254"),
           ("card", "4111 1111 1111 1111"), ("card", "4012888888881881"), ("ssn", "123-45-6789"),
           ("name", "Mrs. Anna Petersen"), ("name", "Herr Karl Müller"), ("iban", "DE89 3704 0044 0532 0130 00")]


@pytest.mark.parametrize("kind,text", SAMPLES)
def test_surrogates_keep_type_and_format(kind, text):
    assert [(k, f"see {text}."[a:b]) for k, a, b in pii.entities(f"see {text}.")] == [(kind, text)]
    new = pii.surrogate(kind, text)
    assert new != text and new == pii.surrogate(kind, text) and new != pii.surrogate(kind, text, b"other key")
    assert [k for k, *_ in pii.entities(f"see {new}.")] == [kind]
    if kind == "card":
        digits = [c for c in new if c.isdigit()]
        assert pii._luhn("".join(digits[:-1])) == int(digits[-1]) and digits[0] == "4"
    if kind not in ("ip", "name"):
        assert re.sub(r"[a-z]", "a", re.sub(r"\d", "9", new)) == re.sub(r"[a-z]", "a", re.sub(r"\d", "9", text))
    if kind == "name":
        assert new.split(" ")[0] == text.split(" ")[0]
        assert pii._GENDER[new.split(" ")[1]] == ("f" if "Mrs" in text else "m")


@pytest.mark.parametrize("size", [2, 3, 10, 257, 1000])
def test_permutation_moves_every_point(size):
    got = [pii.permute(i, size, b"k", "t") for i in range(size)]
    assert sorted(got) == list(range(size)) and all(i != g for i, g in enumerate(got))


def test_surrogates_never_meet(make):
    """Short names, unchecked cards and secrets by the thousand, and other scripts."""
    rng = random.Random(12)
    names = {f"Mr {rng.choice('BCDÉГ')}{''.join(rng.choices('aeilnéг', k=rng.randint(1, 5)))} "
             f"{rng.choice('KLMŁ')}{''.join(rng.choices('aou', k=2))}" for _ in range(4000)}
    names |= {f"Mr {g} {s}" for g in (*pii._GIVEN["m"], *pii._OTHER["m"]) for s in ("Kao", "Lua")}
    cards = {f"4111 1111 1111 {k:04d}" for k in range(2000)}
    secrets = {f'token="{k:08x}"'[:-1] for k in range(500)} | {f'token="{k:08X}'for k in range(500)} | \
        {f'token="zz{k:06d}' for k in range(500)}
    for kind, texts in (("name", names), ("card", cards), ("secret", secrets)):
        new = {t: pii.surrogate(kind, t) for t in texts}
        assert len(set(new.values())) == len(texts) and all(t != n for t, n in new.items())
        for n in random.Random(1).sample(sorted(new.values()), 50):
            shown = n + '"' if kind == "secret" else n
            assert [(k, shown[a:b]) for k, a, b in pii.entities(shown)] == [(kind, n)]
    mails = ["王伟@公司.com", "محمد@شركة.com", "דוד@חברה.co.il", "łóś@żaba.pl"]
    rows = {r.doc_id: r for r in pii.replace_pii(make([*mails, 'password = "********"', "1.2.3.4 01.2.3.4"])).collect()}
    for i, t in enumerate(mails):
        assert rows[i].n_entities == 1 and not set(t.partition("@")[0]) & set(rows[i].text.partition("@")[0])
        assert [k for k, *_ in pii.entities(rows[i].text)] == ["email"]
    assert rows[4].text == 'password = "********"'


def test_pii_rows(make):
    texts = [f"x {t} y" for _, t in SAMPLES] + [f"again {SAMPLES[0][1]}, {SAMPLES[0][1]}", None, "", "plain 12 text", 'token = "0123abcd0123abcd"']
    rows = {r.doc_id: r for r in pii.replace_pii(make(texts)).collect()}
    for i, (_, t) in enumerate(SAMPLES):
        assert rows[i].n_entities == 1 and t not in rows[i].text and rows[i].text.startswith("x ")
    first = rows[0].text[2:-2]
    assert rows[9].text == f"again {first}, {first}"
    assert rows[10].text is None and rows[11].text == "" and rows[12].text == "plain 12 text"
    assert re.fullmatch(r'token = "[0-9a-f]{16}"', rows[13].text) and rows[13].text != texts[13]
    kept = pii.without_pii(make(texts))
    assert kept.columns == make(texts).columns and {r.text for r in kept.collect()} == {r.text for r in rows.values()}


# ---------------------------------------------------------------- toxicity
def test_toxicity_held_out(spark, make):
    rng = random.Random(9)
    bad = ["grobx", "nastyx", "vilex", "meanstemab", "meanstemcd", "meanstemef"]
    texts, labels = [], []
    for i in range(600):
        w = prose(rng, rng.randint(20, 120)).split()
        toxic = i % 5 == 0
        for _ in range(3 if toxic else 0):
            w[rng.randrange(len(w))] = rng.choice(bad)
        texts.append(" ".join(w))
        labels.append((i, 1, int(toxic), "t"))
    texts += ["", None]
    docs = make(texts)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string")
    rows = {r.doc_id: r for r in toxicity.toxicity(docs, lab).collect()}
    assert len(rows) == 602
    for i, r in rows.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert r.predicted == int(r.score >= 0.3)
    held = [(rows[i].predicted, y) for i, _, y, _ in labels if rows[i].held_out]
    assert np.mean([p == y for p, y in held]) > .97
    assert rows[600].score == rows[601].score < .3
    assert {r.predicted for r in toxicity.toxicity(docs, lab.limit(0)).collect()} == {0}
    assert toxicity.toxicity(docs.limit(0), lab).count() == 0


def test_label_model_weighs_voters():
    """EM recovers the classes from noisy, partly copied voters."""
    rng = np.random.default_rng(1)
    y = (rng.random(2000) < .3).astype(float)
    good = [np.where(rng.random(2000) < .9, y, 1 - y) for _ in range(4)]
    poor = np.where(rng.random(2000) < .55, y, 1 - y)
    v = np.stack([*good, poor, poor, poor, poor], 1).astype(np.int8)
    noisy = np.where(rng.random(2000) < .8, y, 1 - y)
    post = toxicity.label_model(v, noisy, trust=.8)
    assert ((post > .5) == (y > .5)).mean() > .97


# ---------------------------------------------------------------- mixing
def test_mixing_meets_targets(spark, make):
    rng = random.Random(3)
    words = {"en": ["ta", "te", "ti"], "de": ["ba", "be", "bi"], "es": ["ka", "ke", "ki"], "fr": ["la", "le", "li"]}
    rows = []
    for i in range(400):
        lang = rng.choices(["en", "de", "es", "fr"], [6, 2, 1, 1])[0]
        rows.append((i, prose(rng, rng.randint(5, 80), words[lang]), lang, "s", 1.0, "x"))
    rows += [(400, "", "en", "s", 1.0, "x"), (401, None, "de", "s", 1.0, "x"), (None, "ta te", "en", "s", 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, rate double, p0 string")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 400, 3)], "doc_id long, toxic int")
    got = mixing.mix(docs, labels).toPandas()
    assert len(got) == 403 and (got.rate >= 0).all()
    total = got.tokens.sum()
    for lang, share in mixing.TARGETS.items():
        assert (got.rate * got.tokens * got[f"p_{lang}"]).sum() / total == pytest.approx(share, abs=1e-5)
    known = got[got.tokens > 0].merge(docs.select("doc_id", "lang").toPandas().rename(columns={"lang": "l"}), on="doc_id")
    assert np.mean([r[f"p_{r['l']}"] > .5 for _, r in known.iterrows()]) > .99
    assert mixing.mix(docs.limit(0), labels).count() == 0
    even = mixing.mix(docs, labels.limit(0)).toPandas()
    assert np.allclose(even.p_en, .25)
