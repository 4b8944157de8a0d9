"""Near-duplicate groups by circulant MinHash.

Two permutations of a universe of 2**20 slots are fixed: the first scatters a
shingle's slot, the second ranks it. Signature coordinate k is the least rank
of a document's slots under the second permutation shifted circularly by k, so
all coordinates come from contiguous windows of one table. Coordinates are
banded, bands propose candidates, and every link is confirmed on the full sets.

No stage emits all pairs of a bucket: documents with equal sets are first
collapsed into a class, and every class is compared with the least class of
each of its buckets, the pivot. Where a pivot's classes are then not all in one
component, each is described by its difference from the pivot, which is short
among near copies, and blocks of them are compared through an inverted index of
these differences: |A ^ B| = |a| + |b| - 2 |a & b| for differences a, b from
one pivot, so the test is that on the full sets. Links alone leave a task.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkit
from millrace.llm.components import components
from millrace.llm.scratch import Scratch
from millrace.llm.sieve import passing, sieve

UNIVERSE_BITS = 20
SEED = 7
#: Probability that a link right at the threshold shares no band.
MISS = 1e-6
MOST_BANDS = 27
#: Documents of a candidate group that one task compares with as many others.
BLOCK = 4096
#: Classes of one bucket that a task compares with its pivot: the pivot's set is repeated once per so many.
BESIDE = 256


def banding(percent: int, miss: float = MISS, most: int = MOST_BANDS) -> tuple[int, int]:
    """(bands, rows): the sharpest bands that miss a link at the threshold with at most that probability."""
    best = (most, 1)
    for rows in range(1, 17):
        share = (percent / 100) ** rows
        bands = 1 if share >= 1 else math.ceil(math.log(miss) / math.log(1 - share))
        if bands <= most:
            best = (bands, rows)
    return best


@lru_cache(maxsize=2)
def _permutations(width: int) -> tuple[np.ndarray, np.ndarray]:
    """The scattering permutation, and all windows of the ranking one, wrapped around."""
    rs = np.random.RandomState(SEED)
    scatter = rs.permutation(1 << UNIVERSE_BITS).astype(np.int64)
    rank = rs.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
    wrapped = np.concatenate([rank, rank[:width]])
    return scatter, np.lib.stride_tricks.sliding_window_view(wrapped, width)


def signature(shingles: np.ndarray, width: int) -> np.ndarray:
    """The circulant MinHash signature of a non-empty set of 64-bit shingle hashes."""
    scatter, windows = _permutations(width)
    slots = scatter[shingles >> np.uint64(64 - UNIVERSE_BITS)]
    out = windows[slots[:512]].min(axis=0)
    for i in range(512, len(slots), 512):
        np.minimum(out, windows[slots[i : i + 512]].min(axis=0), out=out)
    return out


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per row and band; keys of different bands differ."""
    parts = signatures.reshape(len(signatures), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(textkit.mix(np.arange(1, bands + 1, dtype=np.uint64)), (len(signatures), bands)).copy()
    for j in range(rows):
        keys = textkit.mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, j])
    return keys.view(np.int64)


def _sketches(size: int, bands: int, rows: int):
    width = bands * rows
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, names, signatures, filled = [], [], [], []
            for i, own in enumerate(textkit.shingle_sets(batch.column("text"), size)):
                counts.append(len(own))
                names.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                if len(own):
                    filled.append(i)
                    signatures.append(signature(own, width))
            keys = band_keys(np.array(signatures), bands, rows) if filled else np.zeros((0, bands), np.int64)
            lengths = np.zeros(len(counts) + 1, np.int32)
            lengths[1:][filled] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(lengths, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), lists], schema=schema)

    return run


def _full_sets(size: int):
    schema = pa.schema([("node", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, nodes, weight = [], [], 0
            for node, own in zip(batch.column("node").to_pylist(), textkit.shingle_sets(batch.column("text"), size), strict=True):
                held.append(own)
                nodes.append(node)
                weight += len(own)
                if weight > 1 << 20:
                    yield _lists(nodes, held, schema)
                    held, nodes, weight = [], [], 0
            if nodes:
                yield _lists(nodes, held, schema)

    return run


def _lists(nodes: list, held: list[np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in held])]).astype(np.int32)
    values = np.concatenate(held).view(np.int64) if held else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], schema=schema)


def _beside(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (pivot, node, slots, ...) with the sets x of the node and y of the pivot.

    A pivot that many classes meet is dealt out: its set goes to the greatest number
    of slots that a pair of it asks for, each pair to one of its own, so no task gets
    all of them.
    """
    slots = pairs.groupBy("pivot").agg(F.max("slots").alias("slots"))
    pivots = slots.join(sets.select(F.col("node").alias("pivot"), F.col("shingles").alias("y")), "pivot")
    pivots = pivots.select("pivot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "y")
    own = pairs.withColumn("slot", _slot()).drop("slots").join(sets.select("node", F.col("shingles").alias("x")), "node")
    return own.join(pivots.hint("merge"), ["pivot", "slot"])


def _slot() -> Column:
    return F.pmod(F.xxhash64("node", F.lit(3)), F.col("slots")).cast("int")


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Words are split at ASCII white space after lower-casing A-Z; a row's set is
    its distinct `size`-word shingles, or with fewer words its whole sequence.
    Rows whose sets A, B have 100 * |A & B| >= percent * |A | B| are linked;
    component_id is the least id reachable and kept marks the row that bears it.

    Null and wordless texts have an empty set, link with nothing and are kept.
    A row with a null id stands alone: null component_id, kept. Rows that repeat
    an id are one document; each keeps its own count, and they are linked where
    any of their texts is. Other columns, whatever their names, are not read.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "near-dedup")
    bands, rows = banding(percent)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    sketch = scratch.keep(source.mapInArrow(_sketches(size, bands, rows), "doc_id long, n_shingles long, set_id binary, bands array<long>"), "sketch")

    # equal sets have equal bands: one class each, named by its least document
    named = sketch.where("doc_id is not null and set_id is not null")
    least = named.groupBy("set_id").agg(F.min("doc_id").alias("node"))
    classes = named.groupBy("set_id").agg(F.min_by("bands", "doc_id").alias("bands"), F.min("doc_id").alias("node"))

    # buckets with two or more classes, and each class's pivot in each of them; written first, so that both sides of the
    # join are plain exchanges, of which Spark splits a hot band
    entries = classes.select(F.explode("bands").alias("band"), "node")
    # a bucket's classes are dealt to so many slots beside its pivot
    slots = F.ceil(F.count("*") / BESIDE).cast("int").alias("slots")
    shared = scratch.keep(entries.groupBy("band").agg(F.min("node").alias("pivot"), F.max("node").alias("last"), slots).where("pivot < last").select("band", "pivot", "slots"), "shared")
    met = entries.join(shared.hint("merge"), "band").where("node <> pivot").groupBy("node", "pivot").agg(F.max("slots").alias("slots"))
    pairs = scratch.keep(met, "pairs")
    scratch.discard("shared")

    # the full sets of those alone: the sieve keeps other texts from the shuffle, the exact join follows
    wanted = scratch.keep(pairs.select("node").union(pairs.select(F.col("pivot").alias("node"))).distinct(), "wanted")
    near = passing(source, "doc_id", sieve(wanted, "node"))
    texts = near.join(wanted.hint("merge"), near["doc_id"] == wanted["node"], "left_semi").select(F.col("doc_id").alias("node"), "text")
    sets = scratch.keep(texts.mapInArrow(_full_sets(size), "node long, shingles array<long>"), "sets")
    scratch.discard("wanted")

    common = F.size(F.array_intersect("x", "y"))
    first = _beside(pairs, sets).select("node", "pivot", common.alias("common"), (F.size("x") + F.size("y")).alias("sum"))
    first = first.where(F.expr(f"100L * common >= {percent} * (sum - common)"))
    links = scratch.keep(first.select(F.col("node").alias("a"), F.col("pivot").alias("b")).distinct(), "links")
    labels = components(scratch, links, "labels")

    # pivots that still hold several components: their classes' differences, compared in blocks
    held = pairs.select("pivot", "node", "slots").union(pairs.groupBy("pivot").agg(F.max("slots").alias("slots")).select("pivot", F.col("pivot").alias("node"), "slots"))
    placed = held.join(labels, "node", "left").select("pivot", "node", "slots", F.coalesce("component", "node").alias("component"), _slot().alias("slot"))
    split = placed.groupBy("pivot").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("held"), F.max("slots").alias("most")).where("low <> high and held > 2")
    split = split.select("pivot", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("slot"))
    open_ = scratch.keep(placed.join(split, ["pivot", "slot"]).drop("slot"), "open")
    if not open_.isEmpty():
        own = F.array_except("x", "y")
        delta = _beside(open_, sets)
        delta = delta.select("pivot", "node", "component", "blocks", F.size("x").alias("n"), F.concat(own, F.array_except("y", "x")).alias("delta"))
        block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
        dealt = delta.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        dealt = dealt.select("pivot", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "component", "n", "delta")
        keys = ["pivot", "low", "high"]
        more = dealt.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_compared(percent), "a long, b long")
        more = scratch.keep(more, "more")
        labels = components(scratch, links.union(more), "relabel")
    for name in ("pairs", "sets", "links", "open", "more"):
        scratch.discard(name)

    # every row takes its class's component
    named_by = least.join(labels, "node", "left").select("set_id", F.coalesce("component", "node").alias("component_id"))
    return sketch.select("doc_id", "n_shingles", "set_id").join(named_by, "set_id", "left").select(
        "doc_id",
        "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))


def _compared(percent: int):
    """Links between the rows of each group (pivot, low, high), which come one after the other.

    With s = |A| + |B| and d = |A ^ B|, the test is (100 - percent) * s >= (100 + percent) * d.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(block: np.ndarray, low: int, high: int, node: np.ndarray, component: np.ndarray, n: np.ndarray, deltas: list[np.ndarray]) -> list[tuple[int, int]]:
        size = np.array([len(x) for x in deltas], dtype=np.int64)
        over = (100 + percent) * size - (100 - percent) * n
        tokens = np.concatenate(deltas) if len(deltas) else np.zeros(0, np.int64)
        owner = np.repeat(np.arange(len(deltas)), size)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        found, parent = [], {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = x = parent[parent[x]]
            return x

        for i in range(len(node)):
            if low != high and block[i] != low:
                continue
            begin, end = np.searchsorted(tokens, deltas[i], "left"), np.searchsorted(tokens, deltas[i], "right")
            hits = np.concatenate([owner[b:e] for b, e in zip(begin.tolist(), end.tolist(), strict=True)]) if len(begin) else np.zeros(0, np.int64)
            common = np.bincount(hits, minlength=len(node))
            met = (over + over[i] <= 2 * (100 + percent) * common) & (component != component[i])
            if low != high:
                met &= block == high
            for j in np.flatnonzero(met).tolist():
                x, y = root(int(component[i])), root(int(component[j]))
                if x != y:
                    parent[x] = y
                    found.append((int(node[i]), int(node[j])))
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def links() -> list[tuple[int, int]]:
            whole = pa.Table.from_batches(held).combine_chunks()
            column = lambda c: whole.column(c).to_numpy()
            lists = whole.column("delta").combine_chunks()
            lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
            at, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            return compare(column("block"), key[1], key[2], column("node"), column("component"), column("n"), [values[b:e] for b, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)])

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("pivot", "low", "high")]
            change = np.zeros(len(batch), dtype=bool)
            for k in keys:
                change[1:] |= k[1:] != k[:-1]
            edges = [0, *np.flatnonzero(change).tolist(), len(batch)]
            found = []
            for b, e in zip(edges[:-1], edges[1:], strict=True):
                if b == e:
                    continue
                now = tuple(int(k[b]) for k in keys)
                if now != key:
                    found += links() if held else []
                    key, held = now, []
                held.append(batch.slice(b, e - b))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)
        found = links() if held else []
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], schema=schema)

    return run
