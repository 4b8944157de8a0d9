"""Document fingerprints by closed syncmers, in DataFrame functions alone.

A text is cut into units: words (runs without ASCII white space), long ones in
pieces of at most PIECE code points, and single ideographs or kana. Of all runs
of K units, those are anchors whose least inner run of S units (by hash) stands
at either edge. Whether a run is an anchor depends on that run alone, so an
edit changes only the anchors that overlap it, and equal passages have equal
anchors wherever they stand.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch

K, S, PIECE = 6, 2, 24
UNIT = r"[぀-ヿ㐀-䶿一-鿿]|[^\x20\x09-\x0D぀-ヿ㐀-䶿一-鿿]{1,%d}" % PIECE
#: Rows of one ordered range in which a document finds its successor, about; ranges of ids at most.
BLOCK, MOST_RANGES = 256, 1 << 14


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """array<struct<at int, code int>>: the closed syncmers of a text in order, at the index of their first unit.

    A text of 1 to k-1 units has one anchor, of all its units; without units
    there are none. A null text has those of an empty one.
    """
    # hashes of units, then of the inner runs; each step feeds the next by a one-element transform, so nothing is computed twice
    units = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNIT), F.lit(0)), lambda u: F.xxhash64(u))

    def step(value: Column, f) -> Column:
        return F.element_at(F.transform(F.array(value), f), 1)

    def inner(us: Column) -> Column:
        shifted = [F.slice(us, j + 1, F.greatest(F.size(us) - (s - 1), F.lit(0))) for j in range(s)]
        return functools.reduce(lambda a, b: F.zip_with(a, b, lambda x, y: F.xxhash64(x, y)), shifted)

    def closed(us: Column) -> Column:
        w = k - s + 1

        def judged(xs: Column) -> Column:
            ends = F.slice(xs, w, F.size(xs))
            runs = F.zip_with(F.slice(xs, 1, F.size(us) - k + 1), ends, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
            marked = F.transform(runs, lambda x, i: F.when(F.least(x["a"], x["b"]) == F.array_min(F.slice(xs, i + 1, w)), F.struct(i.alias("at"), F.hash(F.slice(us, i + 1, k)).alias("code"))))
            return F.filter(marked, lambda x: x.isNotNull())

        return F.when(F.size(us) >= k, step(inner(us), judged)).when(F.size(us) > 0, F.array(F.struct(F.lit(0).alias("at"), F.hash(us).alias("code")))).otherwise(F.expr("cast(array() as array<struct<at: int, code: int>>)"))

    return step(units, closed)


def fingerprint(codes: Column) -> Column:
    """The anchors' codes in text order, as one string."""
    return F.array_join(F.transform(codes, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), ",")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard likeness of two sets of codes; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    either = F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - common
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


def matches(docs: DataFrame) -> DataFrame:
    """Positional matches of a table (doc_id, anchors): doc_id, at, other_id, other_at for each anchor whose code a lesser document holds.

    other_id is the least document that holds the code, at its first place there, so
    a code that very many share costs a row per anchor and not per pair. Null ids
    match nothing.
    """
    each = docs.where("doc_id is not null").select("doc_id", F.explode("anchors").alias("x")).select("doc_id", "x.at", "x.code")
    first = each.groupBy("code").agg(F.min(F.struct("doc_id", "at")).alias("m"), F.max("doc_id").alias("last")).where("m.doc_id < last")
    first = first.select("code", F.col("m.doc_id").alias("other_id"), F.col("m.at").alias("other_at"))
    return each.join(first, "code").where("doc_id <> other_id").select("doc_id", "at", "other_id", "other_at")


def _next_range(heads: DataFrame) -> DataFrame:
    """heads (range, head) with next_range and next_head, the least range's after the greatest.

    Two levels, so that no task orders more than a thousandth of the ranges.
    """
    heads = heads.withColumn("span", F.floor(F.col("range") / 1024))
    spans = heads.groupBy("span").agg(F.min("range").alias("r"), F.min_by("head", "range").alias("h"))
    order = Window.orderBy("span")
    least = spans.agg(F.min_by(F.struct("r", "h"), "span").alias("least"))
    spans = spans.select("span", F.lead(F.struct("r", "h")).over(order).alias("later")).crossJoin(F.broadcast(least))  # one row
    spans = spans.select("span", F.coalesce("later", "least").alias("later"))
    within = heads.select("span", "range", F.lead(F.struct(F.col("range").alias("r"), F.col("head").alias("h"))).over(Window.partitionBy("span").orderBy("range")).alias("nearer"))
    return within.join(spans, "span").select("range", F.coalesce("nearer", "later").alias("x")).select("range", F.col("x.r").alias("next_range"), F.col("x.h").alias("next_head"))


def _below(splits: Column, count: int, value: Column, equal: bool) -> Column:
    """How many of the sorted splits are less than the value (or equal, if asked), by halving steps."""
    steps = [1 << i for i in reversed(range(max(1, count.bit_length())))]

    def step(at: Column, n: Column) -> Column:
        next_ = F.element_at(splits, F.least(at + n, F.lit(count)))
        return F.when((at + n <= count) & ((next_ <= value) if equal else (next_ < value)), at + n).otherwise(at)

    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), step) if count else F.lit(0)


def placed_by_range(docs: DataFrame, block: int = BLOCK, most: int = MOST_RANGES) -> DataFrame:
    """docs (doc_id, text) with tie (a hash of the text) and range: rows in order of (doc_id, tie), null ids first, in ranges of about `block` rows.

    The ranges' bounds are quantiles of the ids, so gaps between ids don't matter;
    an id that holds several quantiles, and null ids, are dealt to as many ranges by
    their ties. Above `most` ranges these grow instead; the bounds are one array.
    """
    rows, known = docs.agg(F.count("*"), F.count("doc_id")).first()
    count = min(most, known // block)
    splits: list[int] = []
    if count:
        shares = [(i + 1) / (count + 1) for i in range(count)]
        splits = docs.agg(F.percentile_approx("doc_id", F.lit(shares), F.lit(4 * most)).alias("x")).first()["x"]
    bounds = F.lit(splits) if splits else F.expr("cast(array() as array<bigint>)")
    # ties as shares of 0 to 1, in their own order
    share = F.col("tie") / F.lit(2.0**64) + F.lit(0.5)
    low, high = _below(bounds, len(splits), F.col("doc_id"), False), _below(bounds, len(splits), F.col("doc_id"), True)
    dealt = lambda n: F.least(F.floor(share * n), F.greatest(n - 1, F.lit(0))).cast("long")
    nulls = max(1, min(most, -(-(rows - known) // block)))
    place = F.when(F.col("doc_id").isNull(), dealt(F.lit(nulls)) - nulls).otherwise(low + dealt(high - low))
    return docs.withColumn("tie", F.xxhash64("text")).withColumn("range", place.cast("long"))


def with_next(docs: DataFrame, scratch: Scratch, carried: list[str], derive: Callable[[DataFrame], DataFrame] = lambda df: df, block: int = BLOCK) -> DataFrame:
    """derive(docs) with next_<c> for each carried column: that of the following row by doc_id, the first row's after the last.

    One shuffle of the rows, to ranges of ids that hold about as many each, every
    one sorted by itself; where a range ends, the first row of the next one follows.
    Null ids come first; rows that repeat an id follow each other by a hash of their
    texts, so reruns agree.
    """
    placed = placed_by_range(docs, block)
    order = F.struct("doc_id", "tie")
    after = scratch.keep(_next_range(placed.groupBy("range").agg(F.min(order).alias("head"))), "heads")
    # the first row of each range goes to the range before it; 2 * MOST_RANGES rows at most
    sought = F.broadcast(after.select(F.col("range").alias("to_range"), "next_range", "next_head"))
    same = placed["doc_id"].eqNullSafe(sought["next_head.doc_id"]) & (placed["tie"] == sought["next_head.tie"])
    met = placed.join(sought, (placed["range"] == sought["next_range"]) & same)
    heads = met.groupBy("to_range").agg(F.first(F.struct(*docs.columns)).alias("row")).select("to_range", "row.*")
    heads = derive(heads).select("to_range", F.struct(*carried).alias("head"))
    within = Window.partitionBy("range").orderBy("doc_id", "tie")
    lead = derive(placed).withColumn("following", F.lead(F.struct(*carried)).over(within))
    joined = lead.join(heads, lead["range"] == heads["to_range"], "left").withColumn("following", F.coalesce("following", "head"))
    return joined.select(*(c for c in lead.columns if c not in ("range", "tie", "following")), *(F.col(f"following.{c}").alias(f"next_{c}") for c in carried))


def edited(docs: DataFrame, k: int = K, s: int = S, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: its fingerprint, that of its edited text, and the likeness to it and to the next row's.

    The edited text has the last floor(n / 2) code points replaced by the first
    as many, or all, of the next row by ascending doc_id (after the last: the
    first; null ids before all; equal ids by a hash of their texts). Null texts are
    empty; a single row follows itself; every row, repeated ones too, has a row of
    the result; an empty table has none; other columns, whatever their names, are
    not read.
    """
    scratch = Scratch(docs.sparkSession, "fingerprints")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    pairs = with_next(base, scratch, ["text", "found"], lambda df: df.withColumn("found", anchors(F.col("text"), k, s)["code"]))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    changed = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    pairs = pairs.select("doc_id", n.cast("long").alias("n_chars"), "found", "next_found", changed.alias("changed"))
    pairs = pairs.select("doc_id", "n_chars", F.sha2("changed", 256).alias("edited_sha256"), "found", "next_found", anchors(F.col("changed"), k, s)["code"].alias("edited"))
    return pairs.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        fingerprint(F.col("found")).alias("fingerprint"),
        fingerprint(F.col("edited")).alias("edited_fingerprint"),
        likeness(F.col("found"), F.col("edited")).alias("near_edited"),
        likeness(F.col("found"), F.col("next_found")).alias("near_next"),
    )
