"""Document fingerprints: invertible Bloom lookup sketches of paragraphs.

A text's paragraphs (its lines, cut after sentence ends) become distinct 64-bit
digests: 48 bits of xxhash64 and 16 bits that are a hash of these, so that the
XOR of several digests does not pass for one. A sketch has three rows of eight
cells; each digest adds one to the count and itself to the XOR of one cell per
row. Sketches subtract cell by cell. What is left holds only the differing
digests, and peeling recovers them: a cell with count +1 or -1 and a valid XOR
is one digest, which is then taken out of its other cells.

When peeling gets stuck the sketch was too small: the digests are divided by
their next four bits into sixteen sketches of the same size, each subtracted
and peeled alone, up to three times over (16^3 * 24 cells); digests that even these
cannot separate are compared as sets. The work stays proportional to the number
of paragraphs at each step. Likeness is the
share of common digests in all digests of the two texts.

Everything is a DataFrame expression; texts move once by document and each
document receives the start and the digests of its neighbour.

Defined cases: null text counts as empty; a null id sorts after all others; rows
with equal ids sort by the hash of their texts, and exact repeats of a row are
one document with the same result in each row; two texts without paragraphs
have likeness 1; a lone document is its own neighbour; other input columns stay
out. Ids are integers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.functions.arrays import materialize
from vigil.llm.common import only, read, stored
from vigil.llm.registry import register

ROWS, COLUMNS = 3, 8
CELLS = ROWS * COLUMNS
LEVELS = 4
_NO_ID = -(1 << 63)
_BODY = (1 << 48) - 1
_PARAGRAPH = r"\n+|(?<=[.!?])[ \t\r]+"


def digests(text: Column) -> Column:
    """Distinct self-checking digests of a text's paragraphs."""
    def digest(paragraph: Column) -> Column:
        return _bound(F.xxhash64(paragraph).bitwiseAND(F.lit(_BODY)), lambda b: b.bitwiseOR(_check(b)))

    return F.array_distinct(F.transform(F.filter(F.split(text, _PARAGRAPH), lambda p: p != ""), digest))


def _check(body: Column) -> Column:
    return F.shiftleft(F.xxhash64(body), 48)


def _bound(value: Column, use) -> Column:
    """use(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _in_cell(d: Column, j: Column) -> Column:
    """Whether a digest belongs to cell j: its row looks at three bits of it."""
    low = F.call_function("shiftright", d, F.call_function("div", j, F.lit(COLUMNS)).cast("int") * 3)
    return low.bitwiseAND(F.lit(COLUMNS - 1).cast("long")) == F.pmod(j, F.lit(COLUMNS))


def sketch(found: Column) -> Column:
    """The cells of a set of digests: array of (n, x)."""
    def cell(j: Column) -> Column:
        return _bound(F.filter(found, lambda d: _in_cell(d, j)), lambda m: F.struct(
            F.size(m).alias("n"), F.aggregate(m, F.lit(0).cast("long"), lambda a, d: a.bitwiseXOR(d)).alias("x")))

    return F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), cell)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda s, t: F.struct((s.n - t.n).alias("n"), s.x.bitwiseXOR(t.x).alias("x")))


def _is_digest(cell: Column) -> Column:
    return (F.abs(cell.n) == 1) & (F.shiftrightunsigned(cell.x, 48) == F.shiftrightunsigned(
        _check(cell.x.bitwiseAND(F.lit(_BODY))), 48))


def peel(cells: Column, rounds: int = 8) -> Column:
    """(left, right, done): how many digests of either side were recovered,
    and whether nothing is left. Each round takes out all lone digests."""
    zero = F.lit(0)
    start = F.struct(cells.alias("cells"), zero.alias("left"), zero.alias("right"))

    def take(state: Column, lone: Column) -> Column:
        def cleaned(cell: Column, j: Column) -> Column:
            return F.aggregate(F.filter(lone, lambda p: _in_cell(p.x, j)), cell,
                               lambda a, p: F.struct((a.n - p.n).alias("n"), a.x.bitwiseXOR(p.x).alias("x")))

        return F.struct(F.transform(state.cells, cleaned).alias("cells"),
                        (state.left + F.size(F.filter(lone, lambda p: p.n > 0))).alias("left"),
                        (state.right + F.size(F.filter(lone, lambda p: p.n < 0))).alias("right"))

    def step(state: Column, _: Column) -> Column:
        lone = F.array_distinct(F.filter(state.cells, _is_digest))
        return _bound(lone, lambda found: F.when(F.size(found) == 0, state).otherwise(take(state, found)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step, lambda s: F.struct(
        s.left.alias("left"), s.right.alias("right"),
        (~F.exists(s.cells, lambda c: (c.n != 0) | (c.x != 0))).alias("done")))


def difference(a: Column, b: Column, cells: Column | None = None, level: int = 0) -> Column:
    """(left, right): the numbers of digests that only a, only b has. ``cells``:
    the subtracted sketches, if they are there already."""
    first = cells if cells is not None else subtract(sketch(a), sketch(b))
    if level == LEVELS:  # too many digests agree in all the bits used so far
        return F.struct(F.size(F.array_except(a, b)).alias("left"), F.size(F.array_except(b, a)).alias("right"))
    shift = 44 - 4 * level

    def part(k: Column) -> Column:
        mine = lambda d: F.shiftright(d, shift).bitwiseAND(F.lit(15).cast("long")) == k
        return _bound(F.struct(F.filter(a, mine).alias("a"), F.filter(b, mine).alias("b")),
                      lambda s: F.when((F.size(s.a) == 0) | (F.size(s.b) == 0),
                                       F.struct(F.size(s.a).alias("left"), F.size(s.b).alias("right")))
                      .otherwise(difference(s.a, s.b, None, level + 1)))

    def larger() -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.lit(15)), part)
        return F.aggregate(parts, F.struct(F.lit(0).alias("left"), F.lit(0).alias("right")),
                           lambda t, p: F.struct((t.left + p.left).alias("left"), (t.right + p.right).alias("right")))

    def tried(c: Column) -> Column:
        load = F.aggregate(F.slice(c, 1, COLUMNS), F.lit(0), lambda t, x: t + F.abs(x.n))
        return F.when(load <= CELLS * 3 // 4, peel(c)).otherwise(
            F.struct(F.lit(0).alias("left"), F.lit(0).alias("right"), F.lit(False).alias("done")))

    def decided(p: Column) -> Column:
        return F.when(p.done, F.struct(p.left.alias("left"), p.right.alias("right"))).otherwise(larger())

    return _bound(_bound(first, tried), decided)


def likeness(size_a: Column, size_b: Column, diff: Column) -> Column:
    """Common digests over all digests."""
    union = size_a + diff.right
    return F.when(union == 0, F.lit(1.0)).otherwise((size_a - diff.left) / union)


def as_text(cells: Column) -> Column:
    """A sketch as text: count:xor of each cell."""
    return F.concat_ws(",", F.transform(cells, lambda c: F.concat(c.n.cast("string"), F.lit(":"),
                                                                  F.lower(F.hex(c.x)))))


def _neighbours(rows: DataFrame) -> DataFrame:
    """(k, h, need, next_k, next_h): each document's successor in descending
    id, the last one's being the first. ``need``: how much of it goes over."""
    order = (rows.groupBy("k", "h").agg(F.max("n").alias("n"), F.count("*").alias("copies"))
             .orderBy(F.desc("k"), "h").withColumn("m", F.monotonically_increasing_id()))
    order = stored(order, "order")  # pins the numbers
    part = F.shiftright("m", 33)
    ends = order.groupBy(part.alias("p")).agg(F.min("m").alias("head"), F.max("m").alias("tail"))
    files = Window.orderBy("p")  # one row per file of the order
    whole = files.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    jumps = ends.select(F.col("tail").alias("m"), F.coalesce(
        F.lead("head").over(files), F.min("head").over(whole)).alias("to"))
    a = (order.join(jumps, "m", "left")
         .select("k", "h", "n", "copies", F.coalesce("to", F.col("m") + 1).alias("to")))
    b = order.select(F.col("k").alias("next_k"), F.col("h").alias("next_h"), F.col("m").alias("to"))
    return a.join(b, "to").drop("to")


def _held(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once however often they are read."""
    kept = materialize(df, "_held", F.struct(*(c.alias(n) for n, c in columns.items())))
    return kept.select(*df.columns, *(F.col(f"_held.{n}").alias(n) for n in columns))


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next, n_paragraphs) of every document."""
    text = F.coalesce("text", F.lit(""))
    rows = (only(docs, k=key, text="text")
            .select(F.coalesce(F.col("k").cast("long"), F.lit(_NO_ID)).alias("k"), text.alias("text"))
            .withColumn("h", F.xxhash64("text")))
    links = _neighbours(rows.select("k", "h", F.char_length("text").alias("n")))
    links = stored(links, "neighbours")
    give = (rows.join(links.select(F.col("next_k").alias("k"), F.col("next_h").alias("h"),
                                   F.col("k").alias("to_k"), F.col("h").alias("to_h"),
                                   F.floor(F.col("n") / 3).cast("int").alias("need")), ["k", "h"])
            .select(F.col("to_k").alias("k"), F.col("to_h").alias("h"),
                    F.expr("substring(text, 1, need)").alias("head"), digests(F.col("text")).alias("next")))
    if links.filter("copies > 1").limit(1).count():
        give = give.groupBy("k", "h").agg(F.first("head").alias("head"), F.first("next").alias("next"))
    both = rows.join(give, ["k", "h"])
    sets = _held(both, own=digests(F.col("text")), edited=F.expr(
        "concat(substring(text, 1, char_length(text) - cast(floor(char_length(text) / 3) as int)), head)"))
    sets = sets.select(F.nullif(F.col("k"), F.lit(_NO_ID)).alias(key), F.char_length("text").cast("long").alias("n_chars"),
                       "own", "next", F.sha2("edited", 256).alias("edited_sha256"),
                       digests(F.col("edited")).alias("new"))
    sets = _held(sets, changed=F.col("new"))
    cells = _held(sets, own_cells=sketch(F.col("own")), changed_cells=sketch(F.col("changed")),
                  next_cells=sketch(F.col("next")))
    near = _held(cells, d1=difference(F.col("own"), F.col("changed"),
                                      subtract(F.col("own_cells"), F.col("changed_cells"))),
                 d2=difference(F.col("own"), F.col("next"), subtract(F.col("own_cells"), F.col("next_cells"))))
    return near.select(
        key, "n_chars", "edited_sha256", as_text(F.col("own_cells")).alias("fingerprint"),
        as_text(F.col("changed_cells")).alias("edited_fingerprint"),
        likeness(F.size("own"), F.size("changed"), F.col("d1")).alias("near_edited"),
        likeness(F.size("own"), F.size("next"), F.col("d2")).alias("near_next"),
        F.size("own").alias("n_paragraphs"))


@register("op1_fingerprints")
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprints(read(spark, sf_dir, "documents"))
