import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key int, word double"


def prose(rng, n, words=None):
    words = words or ["al", "be", "ce", "du", "en", "fo", "gi", "ha", "il", "jo", "ka", "lu", "mo", "no", "pe", "qu"]
    return " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))


def rows_of(texts):
    """Rows with clashing extra columns; (id, text) pairs or plain texts."""
    out = []
    for i, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (i, t)
        out.append((i, t, "en", f"src{(i or 0) % 3}", len(t or ""), "x", 1, 0.5))
    return out


def sample_texts():
    """Plain, copied, near-copied, short, empty, null, repeated and long texts."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(40, 160)) for _ in range(24)]
    near = []
    for k in range(16):
        w = base[k % 6].split()
        for _ in range(k % 5):
            w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
        near.append(" ".join(w))
    shared = prose(rng, 50)
    mixed = [prose(rng, 30) + "\n" + shared + " " + prose(rng, 30) for _ in range(6)]
    odd = ["", None, "One", "one", "two words", "  \t\n ", "A b c d", "a B c d", "x " * 90, prose(rng, 3000),
           "ünï ÇØdé " * 12, base[0].upper()]
    return base + near + mixed + odd + base[:3]


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts: spark.createDataFrame(rows_of(texts), SCHEMA)


@pytest.fixture(scope="session")
def corpus():
    return sample_texts()
