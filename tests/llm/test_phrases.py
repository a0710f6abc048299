"""Phrase mining against plain n-gram counts."""

import random
import re
from collections import Counter

import pytest
from corpus_fixtures import SCHEMA

from vigil.llm import phrases


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def brute(rows, least, top):
    """Rows of (text, lang)."""
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, 5):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i:i + m])] += 1
    kept = {k: v for k, v in f.items() if len(k[1]) > 1 and v >= least}
    out = []
    for (lang, p), a in kept.items():
        score, _, left, right = min((2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]])
                                    for k in range(1, len(p)))
        inside = any(g == lang and len(q) > len(p) and 100 * b >= 80 * a and
                     any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1)) for (g, q), b in kept.items())
        if not inside:
            out.append((lang, " ".join(p), a, left, right, n[lang], score))
    got = []
    for lang in n:
        mine = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))
        got += [(r[0], i + 1, *r[1:]) for i, r in enumerate(mine[:top])]
    return sorted(got)


def texts(seed, rows, vocabulary):
    rng = random.Random(seed)
    seps = [" ", " ", " ", "  ", "\t", ". ", ",", "\n", " \n ", "!? ", " ", "\x0b"]
    out = []
    for _ in range(rows):
        t = ""
        for _ in range(rng.randint(0, 60)):
            t += rng.choice(vocabulary) + rng.choice(seps)
        out.append((rng.choice(["", " ", "\n"]) + t, rng.choice(["en", "en", "en", "xx", None])))
    return out


def run(spark, rows, least, top):
    df = spark.createDataFrame([(i, t, lang, "s", 1, "x", 1, 0.5) for i, (t, lang) in enumerate(rows)], SCHEMA)
    got = phrases.collocations(df, least=least, top=top)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(map(tuple, got.collect()))


@pytest.mark.parametrize("least,top", [(3, 40), (12, 5), (1, 2000)])
def test_against_plain_counts(spark, least, top):
    rows = texts(least, 60, ["a", "B", "c", "É", "dd", "New", "york", "City", "of", "x'y", "日本", "\x00z"])
    rows += [(None, "en"), ("", None), ("\t .,", "zz"), ("one", "lone"), ("a b a b " * 600, "long")]
    rows += [("New York City of Dreams. new york CITY of dreams", "en")] * 9
    got = run(spark, rows, least, top)
    assert got == brute(rows, least, top)
    assert got


def test_ties_and_empty(spark):
    rows = [("p q. r s. t u", "en")] * 4
    assert run(spark, rows, 4, 2) == [("en", 1, "p q", 4, 4, 4, 24, 1_000_000), ("en", 2, "r s", 4, 4, 4, 24, 1_000_000)]
    assert run(spark, [], 3, 10) == []
    assert run(spark, [("alone", "en")], 3, 10) == []


def test_cut_windows_keep_frequent_counts(spark):
    """Windows end before rare bigrams; single words are never lost."""
    rows = [("the cat sat on", "en")] * 5 + [(f"the w{i} v{i}", "en") for i in range(50)]
    df = spark.createDataFrame(rows, "text string, lang string")
    got = {tuple(filter(None, r[1:5])): r.n for r in phrases.counted_windows(df, 5).collect()}
    assert got[("the", "cat", "sat", "on")] == 5 and got[("the",)] == 50
    assert sum(got.values()) == 5 * 4 + 50 * 3 and max(map(len, got)) == 4
