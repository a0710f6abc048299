"""Personal data replaced by keyed surrogates.

Detected entities - e-mail addresses, phone numbers, IP addresses, card
numbers, quoted secrets, IBANs, social security numbers and titled names - get
a replacement of the same type and format. The replacement is a keyed
permutation (a Feistel network with cycle walking) of the strings of the
entity's own format: digits stay digits, letters keep case and script,
separators and lengths stay, a card number keeps its issuer digit and its Luhn
check, a titled name gets one of the same gender. So equal entities get equal surrogates
in every document (coreference) and different entities of one format different
ones (distinctness), without a lookup table.

Every kind's replacement can be undone with the key, so no two entities meet:
classes of a kind (hex or other secrets, cards with and without a check) keep to
themselves, and a given name outside the list lends its letters to the surname,
which gets longer. ``check_distinct`` holds this over the whole corpus: distinct
entities are gathered with a map-side combined group-by, and two that share a
surrogate, or one that keeps its own, raise an error. Nothing but such cases'
counts reaches the driver.

Letters outside the fixed alphabets are replaced by others of their Unicode
script and category.

Defined cases: what has no letter or digit to replace stays as it is; spellings
of an IP address with leading zeros are one entity; null text stays null, with no entities; empty text stays empty;
repeated rows and null ids are treated alike; matches never overlap, the
leftmost, then the earlier kind, wins; other input columns stay out of
``replace_pii`` and untouched in ``without_pii``.
"""

from __future__ import annotations

import hashlib
import secrets
import sys
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import arrow_map, only, read
from vigil.llm.registry import register

#: Session setting with the secret that a corpus' surrogates are made with. A
#: session without one gets a random one, so that nobody can undo them.
KEY_SETTING = "spark.vigil.pii.key"
#: For calls of ``surrogate`` outside a session.
KEY = b"vigil-surrogates"

# Fixed patterns, tried in this order.
_KINDS = {
    "email": r"[\p{L}\p{N}_.%+-]+@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": r"(?i:(?:api[_-]?key|secret|token|password|passwd)\s*[=:]\s*[\"'])[^\"'\s]{8,}(?=[\"'])",
    "iban": r"\b[A-Z]{2}\d{2}(?:[ ]?[A-Z0-9]{4}){3,7}(?:[ ]?[A-Z0-9]{1,3})?\b",
    "ssn": r"\b\d{3}-\d{2}-\d{4}\b",
    "card": r"(?<![\d.-])(?:\d{4}[ -]){3}\d{4}(?![\d-])|(?<![\d.])\d{13,19}(?![\d])",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
             r"|(?<![\w.])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "name": r"\b(?:Mr|Mrs|Ms|Miss|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?[ ]\p{Lu}\p{Ll}+(?:[ ]\p{Lu}\p{Ll}+)?",
}
_ANY = regex.compile("|".join(f"(?P<{k}>{p})" for k, p in _KINDS.items()))
_HINT = regex.compile(r"[@\d]|[\"']|\b(?:M(?:r|rs|s|me|iss|adame|onsieur)|Herr|Frau|Se[ñ]ora?|Sra?)\b")
_SECRET_HEAD = regex.compile(r"^.*?[=:]\s*[\"']")
_FEMALE_TITLES = {"Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra"}
# Fixed given names of each gender.
_GIVEN = {
    "f": ("Alma", "Beatrice", "Clara", "Dora", "Elena", "Freya", "Greta", "Hanna", "Ines", "Julia",
          "Karin", "Laura", "Marta", "Nora", "Olga", "Paula", "Rosa", "Sofia", "Tessa", "Vera"),
    "m": ("Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas",
          "Karl", "Luis", "Martin", "Nils", "Oscar", "Pablo", "Robert", "Simon", "Tomas", "Victor"),
}
# Fixed given names that stand for all others.
_OTHER = {
    "f": ("Agnes", "Birgit", "Celia", "Daria", "Edith", "Flora", "Gloria", "Helga", "Irene", "Judith",
          "Katja", "Lydia", "Miriam", "Nadia", "Odette", "Petra", "Renata", "Silvia", "Teresa", "Ursula"),
    "m": ("Albert", "Bernard", "Conrad", "Dieter", "Edgar", "Franz", "Gregor", "Henrik", "Igor", "Jakob",
          "Klaus", "Lorenz", "Marco", "Norbert", "Otto", "Philip", "Ralf", "Stefan", "Theo", "Walter"),
}
_GENDER = {name: g for lists in (_GIVEN, _OTHER) for g, names in lists.items() for name in names}
# Fixed alphabets by script.
_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789",
              "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
              "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
              "äöüßéèêëàâáíîïóôúûçñœæåø", "ÄÖÜÉÈÊËÀÂÁÍÎÏÓÔÚÛÇÑŒÆÅØ")
_HEX = ("0123456789abcdef", "0123456789ABCDEF")
_LETTER = {c: (a, i) for a in _ALPHABETS for i, c in enumerate(a)}


@lru_cache(maxsize=1)
def _scripts() -> dict[str, tuple[str, int]]:
    """Alphabet and place of the letters and digits outside the fixed ones, by
    script (the first word of a character's name) and category."""
    groups: dict[tuple[str, str], list[str]] = {}
    for c in map(chr, range(128, sys.maxunicode + 1)):
        kind = unicodedata.category(c)
        if kind[0] in "LN" and c not in _LETTER:
            groups.setdefault((unicodedata.name(c, "").split(" ")[0], kind), []).append(c)
    for name in [k for k, v in groups.items() if len(v) < 2]:  # alone in its script
        groups.setdefault(("", name[1]), []).extend(groups.pop(name))
    return {c: (a, i) for a in map("".join, groups.values()) for i, c in enumerate(a)}


def _place(c: str, letters: dict = _LETTER) -> tuple[str, int] | None:
    return letters.get(c) or (_scripts().get(c) if letters is _LETTER and ord(c) > 127 else None)


def permute(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0..size-1 that moves every point (size > 1): a
    step of one on the circle that a Feistel network shuffles."""
    if size < 2:
        return x
    half = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << half) - 1

    def pad(r: int, b: int) -> int:
        h = hashlib.blake2b(f"{tweak}|{size}|{r}|{b}".encode(), key=key, digest_size=min(64, half // 8 + 8))
        return int.from_bytes(h.digest(), "big") & mask

    def shuffled(v: int, rounds) -> int:
        while True:
            a, b = v >> half, v & mask
            for r in rounds:
                a, b = b, a ^ pad(r, b)
            v = b << half | a  # halves swapped: the same rounds backwards undo it
            if v < size:       # walk the cycle back into the domain
                return v

    return shuffled((shuffled(x, range(8)) + 1) % size, range(7, -1, -1))


def _format_kept(text: str, key: bytes, tweak: str, letters: dict = _LETTER) -> str:
    """Permute the string among those of its own format."""
    places = [_place(c, letters) for c in text]
    size, x = 1, 0
    for p in places:
        if p:
            x, size = x * len(p[0]) + p[1], size * len(p[0])
    shape = "".join(p[0][0] if p else c for c, p in zip(text, places, strict=True))
    y = permute(x, size, key, f"{tweak}|{shape}")
    out = []
    for c, p in zip(reversed(text), reversed(places), strict=True):
        if p:
            y, i = divmod(y, len(p[0]))
            c = p[0][i]
        out.append(c)
    return "".join(reversed(out))


def _luhn(digits: str) -> int:
    """The check digit for the given payload."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (2 - i % 2)
        total += n - 9 if n > 9 else n
    return -total % 10


def _checked(digits: str) -> bool:
    return _luhn(digits[:-1]) == int(digits[-1])


def _card(text: str, key: bytes, tweak: str) -> str:
    body = "".join(c for c in text if c.isdigit())
    new, checked = body, _checked(body)
    while new == body or _checked(new) != checked:  # walk on among those without a check
        rest = _format_kept(new[1:-1] if checked else new[1:], key, f"{tweak}|{checked}")
        new = new[0] + rest
        new += str(_luhn(new)) if checked else ""
    it = iter(new)
    return "".join(next(it) if c.isdigit() else c for c in text)


def _ip(text: str, key: bytes, tweak: str) -> str:
    n = 0
    for part in text.split("."):
        n = n << 8 | int(part)
    n = permute(n, 1 << 32, key, tweak)
    return ".".join(str(n >> s & 255) for s in (24, 16, 8, 0))


def _phone(text: str, key: bytes, tweak: str) -> str:
    head = regex.match(r"\+\d{1,3}(?=[ .(-])", text)  # the country stays
    at = head.end() if head else 0
    return text[:at] + _format_kept(text[at:], key, f"{tweak}|{text[:at]}")


def _iban(text: str, key: bytes, tweak: str) -> str:
    return text[:2] + _format_kept(text[2:], key, f"{tweak}|{text[:2]}")


def _email(text: str, key: bytes, tweak: str) -> str:
    local, _, domain = text.rpartition("@")
    name, dot, rest = domain.partition(".")
    return (_format_kept(local, key, f"{tweak}|{domain}") + "@" + _format_kept(name, key, f"{tweak}|@{rest}")
            + dot + rest)


def _name(text: str, key: bytes, tweak: str) -> str:
    title, *words = text.split(" ")
    gender = "f" if title.rstrip(".") in _FEMALE_TITLES else "m"
    if len(words) == 2:
        gender = _GENDER.get(words[0], gender)
        if words[0] not in _GIVEN[gender]:
            return f"{title} {_other_name(*words, gender, key, f'{tweak}|{title}')}"
    out = [title]
    if len(words) == 2:
        names = _GIVEN[gender]
        out.append(names[permute(names.index(words[0]), len(names), key, f"{tweak}|given")])
    out.append(_format_kept(words[-1], key, f"{tweak}|{' '.join(words[:-1])}"))
    return " ".join(out)


def _other_name(given: str, surname: str, gender: str, key: bytes, tweak: str) -> str:
    """Both words as one number: which of the other given names, and the
    letters of both words in the surname. The surname's initial is written
    small, or as four letters; where it was is part of the number."""
    first, plain = ord(surname[0]), "A" <= surname[0] <= "Z"
    code = surname[0].lower() if plain else "".join(chr(97 + first // 26 ** k % 26) for k in (3, 2, 1, 0))
    letters = given + code + surname[1:]
    names, more = _OTHER[gender], 0
    while len(names) * 26 ** more < 2 * len(letters):
        more += 1
    x = 2 * len(given) + plain
    places = [_place(c) for c in letters]
    for p in places:
        x = x * len(p[0]) + p[1]
    places += [_place("a")] * more
    size = len(names)
    for p in places:
        size *= len(p[0])
    y = permute(x, size, key, f"{tweak}|{gender}|{''.join(p[0][0] for p in places)}")
    out = []
    for p in reversed(places):
        y, i = divmod(y, len(p[0]))
        out.append(p[0][i])
    return f"{names[y]} {''.join(reversed(out))}"


def _hex(body: str) -> str | None:
    return next((h for h in _HEX if set(body) <= set(h)), None)


def _secret(text: str, key: bytes, tweak: str) -> str:
    head = _SECRET_HEAD.match(text).group()
    body = new = text[len(head):]
    hexed = _hex(body)
    letters = {c: (hexed, i) for i, c in enumerate(hexed)} if hexed else _LETTER
    while True:  # walk on among those of the same class
        new = _format_kept(new, key, f"{tweak}|{hexed}", letters)
        if _hex(new) == hexed:
            return head + new


_MAKERS = {"email": _email, "secret": _secret, "card": _card, "ip": _ip, "phone": _phone, "name": _name, "iban": _iban}


@lru_cache(maxsize=100_000)
def surrogate(kind: str, text: str, key: bytes = KEY) -> str:
    """The replacement of an entity."""
    return _MAKERS.get(kind, _format_kept)(text, key, kind)


def entities(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, first, end) of every entity, in order."""
    if not text or not _HINT.search(text):
        return []
    return [(m.lastgroup, m.start(), m.end()) for m in _ANY.finditer(text)]


def _same_entity(kind: str, text: str) -> str:
    return ".".join(str(int(p)) for p in text.split(".")) if kind == "ip" else text


def _replaceable(kind: str, text: str) -> bool:
    """Has a letter or digit that its surrogate may change."""
    if kind == "email":
        local, _, domain = text.rpartition("@")
        text = local + domain.partition(".")[0]
    elif kind == "secret":
        text = text[_SECRET_HEAD.match(text).end():]
    return regex.search(r"[\p{L}\p{N}]", text) is not None


def session_key(spark: SparkSession) -> bytes:
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return spark.conf.get(KEY_SETTING).encode()


def check_distinct(docs: DataFrame, key: bytes) -> None:
    """Raise if two entities of the corpus share a surrogate, or one that has
    something to replace keeps its own."""
    def gather(part):
        found = {(k, _same_entity(k, t[a:b])) for t in part.column("text").to_pylist() for k, a, b in entities(t)}
        if not found:
            return None
        kind, text = zip(*sorted(found), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(text)], ["kind", "text"])

    def replace(batches):
        for b in batches:
            rows = list(zip(b.column("kind").to_pylist(), b.column("text").to_pylist(), strict=True))
            new = [surrogate(k, t, key) for k, t in rows]
            kept = [n == t and _replaceable(k, t) for n, (k, t) in zip(new, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(new, pa.string()),
                                              pa.array(kept, pa.bool_())], ["kind", "new", "kept"])

    each = only(docs, text="text").mapInArrow(arrow_map(gather), "kind string, text string").distinct()
    made = each.mapInArrow(replace, "kind string, new string, kept boolean")
    clash = (made.groupBy("kind", "new").agg(F.count("*").alias("n"), F.max("kept").alias("kept"))
             .filter("n > 1 or kept").groupBy("kind").count().collect())  # a row per kind
    if clash:
        raise ValueError(f"surrogates that are shared or kept: {sorted((r[0], r[1]) for r in clash)}")


def _replaced(key: bytes):
    def one(text: str | None) -> tuple[str | None, list[str]]:
        found = entities(text)
        if not found:
            return text, []
        out, at = [], 0
        for kind, a, b in found:
            out += [text[at:a], surrogate(kind, text[a:b], key)]
            at = b
        return "".join([*out, text[at:]]), [k for k, *_ in found]
    return one


def replace_pii(docs: DataFrame, key: bytes | None = None, id_column: str = "doc_id") -> DataFrame:
    """(id, n_entities, kinds, text) of every document, its entities replaced
    with the given key, or else the session's."""
    key = key or session_key(docs.sparkSession)
    src = only(docs, id=id_column, text="text")
    check_distinct(src, key)
    one = _replaced(key)
    kind = src.schema["id"].dataType.simpleString()

    def run(part):
        done = [one(t) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [part.column("id"), pa.array([len(k) for _, k in done], pa.int64()),
             pa.array([",".join(sorted(set(k))) for _, k in done], pa.string()),
             pa.array([t for t, _ in done], pa.string())], ["id", "n_entities", "kinds", "text"])

    return (src.mapInArrow(arrow_map(run), f"id {kind}, n_entities long, kinds string, text string")
            .withColumnRenamed("id", id_column))


def without_pii(docs: DataFrame, key: bytes | None = None) -> DataFrame:
    """The same columns with entities of ``text`` replaced."""
    key = key or session_key(docs.sparkSession)
    check_distinct(docs, key)
    one = _replaced(key)
    at = docs.columns.index("text")

    def run(part):
        texts = [one(t)[0] for t in part.column("text").to_pylist()]
        return part.set_column(at, "text", pa.array(texts, pa.string()))

    return docs.mapInArrow(arrow_map(run), docs.schema)


@register("op8_pii")
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with personal data replaced."""
    return replace_pii(read(spark, sf_dir, "documents"))
