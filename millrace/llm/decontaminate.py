"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on hashes of `tile` consecutive words
(seeds). For each pair that seeds could cover enough of, running Karp-Rabin
greedy string tiling marks the longest matches that don't overlap, again and
again, down to that length. A document is contaminated by an item if its tiles
cover the threshold share of the item's words, in whatever order they stand.

The benchmark is a table like any other: a sieve of its seeds, of fixed size,
tells which words of a document matter, and only those are shuffled. Of an
item's seeds, the commonest that don't cover enough of it together propose no
pair, so a phrase that all items and documents share makes no pairs of all.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import textkit
from millrace.llm.scratch import Scratch, fresh
from millrace.llm.sieve import among, bitmap, marked, sieve

TILE, COVERAGE = 5, 0.6
#: The first length that tiling looks for.
FIRST_LENGTH = 20


def _windows(tokens: np.ndarray, length: int) -> np.ndarray:
    """Karp-Rabin hashes of all runs of `length` tokens."""
    power, inverse = textkit.powers(len(tokens) + 1)
    total = np.zeros(len(tokens) + 1, dtype=np.uint64)
    np.cumsum(tokens * power[: len(tokens)], out=total[1:])
    n = len(tokens) - length + 1
    return (total[length:] - total[:n]) * inverse[:n]


def tiles(item: np.ndarray, doc: np.ndarray, tile: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of two token sequences: (start in item, start in doc, length), longest first."""
    marked_item, marked_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    length = max(tile, FIRST_LENGTH)
    while True:
        longest, queue = 0, []
        if min(len(item), len(doc)) >= length:
            free = lambda marked: np.convolve(marked, np.ones(length, int), "valid") == 0
            where = defaultdict(list)
            doc_hashes = _windows(doc, length)
            for j in np.flatnonzero(free(marked_doc)).tolist():
                where[int(doc_hashes[j])].append(j)
            item_hashes = _windows(item, length)
            for i in np.flatnonzero(free(marked_item)).tolist():
                for j in where.get(int(item_hashes[i]), ()):
                    if i and j and item[i - 1] == doc[j - 1] and not marked_item[i - 1] and not marked_doc[j - 1]:
                        continue  # a longer match begins before it
                    most = min(len(item) - i, len(doc) - j)
                    stop = np.flatnonzero((item[i : i + most] != doc[j : j + most]) | marked_item[i : i + most] | marked_doc[j : j + most])
                    k = int(stop[0]) if len(stop) else most
                    if k >= length:
                        queue.append((-k, i, j))
                        longest = max(longest, k)
        if longest > 2 * length:
            length = longest
            continue
        heapq.heapify(queue)
        while queue:
            k, i, j = heapq.heappop(queue)
            k = -k
            taken = marked_item[i : i + k] | marked_doc[j : j + k]
            if not taken.any():
                marked_item[i : i + k] = marked_doc[j : j + k] = True
                out.append((i, j, k))
                continue
            edges = np.flatnonzero(np.diff(np.concatenate([[1], taken.astype(int), [1]])))
            for b, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if e - b >= length:
                    heapq.heappush(queue, (b - e, i + b, j + b))
        if length > 2 * tile:
            length //= 2
        elif length > tile:
            length = tile
        else:
            return out


def _items(tile: int):
    """Each item's words and the seeds that begin at them; an item of fewer words than a tile is one seed."""
    schema = pa.schema([("item_id", pa.int64()), ("words", pa.list_(pa.int64())), ("seeds", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.text_buffers(batch.column("text"))
            for row, end, part, at in textkit.chunks(data, offsets):
                starts, ends, first = textkit.word_spans(part, at)
                words = textkit.span_hashes(part, starts, ends)
                seeds, rows = textkit.shingle_hashes(words, first, tile)
                lists = [pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v.view(np.int64))) for o, v in ((first, words), (rows, seeds))]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").slice(row, end - row), *lists], schema=schema)

    return run


def _hits(tile: int, held):
    """For each document with seeds that may be an item's: these, and the words that they cover with their places."""
    lists = [("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("words", pa.list_(pa.int64()))]
    schema = pa.schema([("doc_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), *lists])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.text_buffers(batch.column("text"))
            rows_out, out = [], []
            for row, _, part, at in textkit.chunks(data, offsets):
                starts, ends, first = textkit.word_spans(part, at)
                words = textkit.span_hashes(part, starts, ends)
                seeds, rows = textkit.shingle_hashes(words, first, tile)
                may = among(seeds, held.value)
                seen = np.concatenate([[0], np.cumsum(may)])
                for i in np.flatnonzero(seen[rows[1:]] > seen[rows[:-1]]).tolist():
                    n = int(first[i + 1] - first[i])
                    begins = np.flatnonzero(may[rows[i] : rows[i + 1]])
                    covered = np.zeros(n + 1, np.int32)
                    np.add.at(covered, begins, 1)
                    np.add.at(covered, np.minimum(begins + tile, n), -1)
                    places = np.flatnonzero(np.cumsum(covered[:-1]) > 0)
                    own = words[first[i] : first[i + 1]]
                    out.append((np.unique(seeds[rows[i] : rows[i + 1]][begins]).view(np.int64), places.astype(np.int32), own[places].view(np.int64)))
                    rows_out.append(row + i)
            if rows_out:
                kept = batch.select(["doc_id", "low", "high"]).take(pa.array(rows_out))
                yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array([x[k] for x in out], t) for k, (_, t) in enumerate(lists))], schema=schema)

    return run


def key_seeds(n: int, often: list[int], tile: int, coverage: float) -> list[int]:
    """Which seeds (by their first word) propose pairs for an item of n words.

    often: in how many documents each of its seeds stands. The commonest are left
    out as long as they cover less than `coverage` of it together: a document that
    covers as much has one of the others.
    """
    covered, left = np.zeros(n, bool), set(range(len(often)))
    for at in sorted(left, key=lambda i: (-often[i], i)):
        covered[at : at + tile] = True
        if covered.sum() >= coverage * n:
            break
        left.discard(at)
    return sorted(at for at in left if often[at])


def _keys(tile: int, coverage: float):
    schema = pa.schema([("item", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(item, at) for item, n, often in zip(*(batch.column(c).to_pylist() for c in ("item", "n", "often")), strict=True) for at in key_seeds(n, often, tile, coverage)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], t) for k, t in enumerate(schema.types)], schema=schema)

    return run


def covering(item: np.ndarray, places: np.ndarray, words: np.ndarray, tile: int, coverage: float) -> tuple[float, list[tuple[int, int, int]]] | None:
    """(covered share, tiles) of an item by a document's words at those places, or none if they cover too little."""
    tile = min(tile, len(item))
    if np.isin(item, words).sum() < coverage * len(item):
        return None
    # a gap that matches nothing between the runs of words
    gaps = np.flatnonzero(np.diff(places) > 1) + 1
    part, where = np.insert(words, gaps, np.uint64(0)), np.insert(places, gaps, -1)
    met = [(i, int(where[j]), k) for i, j, k in tiles(item, part, tile)]
    share = sum(k for _, _, k in met) / len(item)
    return (share, met) if share >= coverage else None


def _tiled(tile: int, coverage: float):
    tile_type = pa.list_(pa.struct([("item_start", pa.int32()), ("doc_start", pa.int32()), ("length", pa.int32())]))
    schema = pa.schema([("doc_id", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", tile_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, shares, found = [], [], []
            lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("item_words", "places", "words")]
            for r in range(len(batch)):
                item, places, words = (v[o[r] : o[r + 1]] for o, v in lists)
                if (met := covering(item.view(np.uint64), places, words.view(np.uint64), tile, coverage)) is not None:
                    rows.append(r)
                    shares.append(met[0])
                    found.append([dict(zip(("item_start", "doc_start", "length"), t, strict=True)) for t in met[1]])
            kept = batch.select(["doc_id", "low", "high", "item_id"]).take(pa.array(rows, pa.int32()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(shares, pa.float64()), pa.array(found, tile_type)], schema=schema)

    return run


def _leaks(spark: SparkSession, scratch: Scratch, rows: DataFrame, benchmark: DataFrame, tile: int, coverage: float) -> DataFrame:
    """Leaks of rows (doc_id, text, low, high), with low and high."""
    given = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = given.mapInArrow(_items(tile), "item_id long, words array<long>, seeds array<long>").withColumn("item", F.monotonically_increasing_id())
    items = scratch.keep(items, "items")
    seeds = items.select("item", F.posexplode("seeds").alias("at", "seed"))
    held = spark.sparkContext.broadcast(bitmap(seeds, "seed"))
    hits = rows.mapInArrow(_hits(tile, held), "doc_id long, low long, high long, seeds array<long>, places array<int>, words array<long>")
    hits = scratch.keep(hits.withColumn("row", F.monotonically_increasing_id()), "hits")
    places = hits.select("row", F.explode("seeds").alias("seed"))

    often = places.groupBy("seed").agg(F.count("*").alias("often"))
    counted = seeds.join(often, "seed", "left").groupBy("item").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("often", F.lit(0)).alias("often")))).alias("x"))
    counted = counted.join(items.select("item", F.size("words").alias("n")), "item").select("item", "n", F.col("x.often").alias("often"))
    keys = counted.mapInArrow(_keys(tile, coverage), "item long, at int")
    keys = scratch.keep(seeds.join(keys, ["item", "at"]).select("item", "seed").distinct(), "keys")
    pairs = places.join(keys, "seed").select("row", "item").distinct()
    both = pairs.join(hits.drop("seeds"), "row").join(items.select("item", "item_id", F.col("words").alias("item_words")), "item")
    columns = "doc_id long, low long, high long, item_id long, coverage double, tiles array<struct<item_start: int, doc_start: int, length: int>>"
    return both.select("doc_id", "low", "high", "item_id", "item_words", "places", "words").mapInArrow(_tiled(tile, coverage), columns)


def leaks(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """doc_id, item_id, coverage, tiles, contaminated (true): a row per row of docs and item that it covers enough of.

    Words are lower-cased and split at ASCII white space. An item of fewer than
    `tile` words is covered by a document of the same words and no others; null and
    empty texts cover nothing. Repeated rows of either table give a row each; null
    ids are carried; other columns, whatever their names, are not read; an empty
    table of either kind gives an empty result.
    """
    zero = F.lit(0).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), zero.alias("low"), zero.alias("high"))
    found = _leaks(docs.sparkSession, Scratch(docs.sparkSession, "leaks"), rows, benchmark, tile, coverage)
    return found.drop("low", "high").withColumn("contaminated", F.lit(True))


def clean(docs: DataFrame, benchmark: DataFrame, tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """The rows of docs, with all their columns, that no item of the benchmark contaminates.

    Rows are told by 128 bits of hashes of their text, on which alone it depends:
    repeated rows and ids go or stay alike, null ids and texts stay, any other
    columns are carried. A sieve of the contaminated texts' hashes keeps other rows
    from the shuffle; an exact join follows for the rest.
    """
    scratch = Scratch(docs.sparkSession, "clean")
    text = F.col("text").cast("string")
    low, high, may = (fresh(docs, n) for n in ("clean_low", "clean_high", "clean_may"))
    told = docs.withColumn(low, F.xxhash64(text)).withColumn(high, F.xxhash64(F.lit(1), text))
    rows = told.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.col(low).alias("low"), F.col(high).alias("high"))
    found = scratch.keep(_leaks(docs.sparkSession, scratch, rows, benchmark, tile, coverage).select(F.col("low").alias(low), F.col("high").alias(high)).distinct(), "found")
    sifted = marked(told, low, sieve(found, low), may)
    exact = sifted.where(may).join(found.hint("merge"), [low, high], "left_anti")
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return sifted.where(~F.col(may)).select(*columns).union(exact.select(*columns))
