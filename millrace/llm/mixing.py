"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is permuted by a hash and cut into blocks. A source's target gives
it whole passes over its blocks and one partial pass; these exact block quotas
are split among the output shards by a tree whose nodes draw, for their left
half, a multivariate-hypergeometric sample of what they hold. Each shard then
takes the next blocks of every source's permuted order, so shards are disjoint,
and its rows are shuffled by a hash of their own.

Sources may be as many as hosts are: their table is never on the driver. The
tree splits the sums of GROUPS groups of sources there, and each group's task
splits its own share on among its sources, which is the same draw in two steps.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.scratch import Scratch, fresh

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
#: A document's words are taken at most so many times.
CAP = 3
#: Rows that a block has about, and the most blocks of a source, as a power of two.
BLOCK_ROWS, MOST_BITS = 64, 20
SHARDS, SEED = 32, 11
#: Groups of sources that the tree splits first; bits of a block's number within a run that is summed by itself; leading bits of draws that are counted first.
GROUPS, RUN_BITS, DRAW_BITS = 1024, 5, 10


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, share: Fraction = Fraction(1), cap: int = CAP) -> dict[str | None, Fraction]:
    """Each source's target: `share` of all sizes by weight, none above cap times its size, the excess reshared by weight.

    Weights go round over the sources by code point, null last. Where all are at
    their cap, what is left is dropped.
    """
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = Fraction(sum(sizes.values())) * share, set(names), {}
    while open_:
        whole = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] > cap * sizes[s] * whole}
        if not over:
            out |= {s: left * weight[s] / whole for s in open_}
            break
        out |= {s: Fraction(cap * sizes[s]) for s in over}
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def split_tree(quotas: list[int], shards: int, seed: int | list[int] = SEED, sizes: list[int] | None = None) -> np.ndarray:
    """(shards, sources) block counts that add up to the quotas; shards' sums are `sizes`, or differ by one at most.

    A node's draw depends on the seed and its place alone.
    """
    out = np.zeros((shards, len(quotas)), dtype=np.int64)
    total = sum(quotas)
    edges = [total * i // shards for i in range(shards + 1)] if sizes is None else [0, *np.cumsum(sizes).tolist()]
    seeds = seed if isinstance(seed, list) else [seed]
    todo = [(0, shards, np.asarray(quotas, dtype=np.int64))]
    while todo:
        low, high, held = todo.pop()
        if high - low == 1:
            out[low] = held
            continue
        middle = (low + high) // 2
        draw = np.random.Generator(np.random.PCG64([*seeds, low, high]))
        left = draw.multivariate_hypergeometric(held, edges[middle] - edges[low], method="marginals") if len(held) else held
        todo += [(low, middle, left), (middle, high, held - left)]
    return out


def turns(quotas: pd.DataFrame, group: int, shards: int, seed: int, sizes: list[int]) -> pd.DataFrame:
    """slot, shard, low, high: which turns of each source (slot, n) of one group every shard takes, if it takes `sizes` of the group."""
    quotas = quotas.sort_values("slot")
    slot, n = quotas["slot"].to_numpy(), quotas["n"].to_numpy()
    upto = np.cumsum(split_tree(n.tolist(), shards, [seed, group], sizes), axis=0)
    before = np.vstack([np.zeros((1, len(n)), np.int64), upto[:-1]])
    shard, at = np.nonzero(upto > before)
    return pd.DataFrame({"slot": slot[at], "shard": shard.astype(np.int32), "low": before[shard, at], "high": upto[shard, at] - 1})


def _fitting(rows: pd.DataFrame) -> pd.DataFrame:
    """Of one block's rows by hash, all that still fit; then rows are added or exchanged as long as that comes nearer."""
    rows = rows.sort_values(["hash", "doc_id", "size", "row"])
    size, left = rows["size"].to_numpy(), int(rows["left"].iloc[0])
    taken = np.zeros(len(rows), bool)
    for i, n in enumerate(size.tolist()):
        if n <= left:
            taken[i] = True
            left -= n
    while left:
        # the row out (or none) and the row in whose difference is nearest to what is missing
        ins, outs = np.flatnonzero(~taken), np.concatenate([[-1], np.flatnonzero(taken)])
        if not len(ins):
            break
        ins = ins[np.argsort(size[ins], kind="stable")]
        wish = np.where(outs < 0, 0, size[outs]) + left
        at = np.clip(np.searchsorted(size[ins], wish), 1, len(ins)) - 1
        best = min((abs(int(wish[k] - size[ins[j]])), k, int(j)) for k, i in enumerate(at.tolist()) for j in (i, min(i + 1, len(ins) - 1)))
        if best[0] >= abs(left):
            break
        left = int(wish[best[1]] - size[ins[best[2]]])
        taken[ins[best[2]]] = True
        if outs[best[1]] >= 0:
            taken[outs[best[1]]] = False
    return pd.DataFrame({"slot": rows["slot"].iloc[0], "block": rows["block"].iloc[0], "row": rows["row"].to_numpy()[taken]})


@dataclass
class Mix:
    """A mix as decided: rows (the documents' keys) with their source's figures, and the blocks' places in it."""

    rows: DataFrame
    places: DataFrame

    def taken(self) -> DataFrame:
        """Per document: doc_id, size, source_size, target, taken (its words in the mix, repeats counted), shards and orders.

        shards: where each of its copies goes; orders: by what it is sorted there.
        """
        listed = F.array_sort(F.collect_list(F.struct("copy", "shard", "partial")))
        held = self.places.groupBy("slot", "block").agg(listed.alias("held"))
        joined = self.rows.join(held, ["slot", "block"], "left")
        own = F.filter(F.coalesce("held", F.expr("cast(array() as array<struct<copy: int, shard: int, partial: boolean>>)")), lambda x: ~x["partial"] | F.col("in_cut"))
        joined = joined.withColumn("own", F.when(F.col("size") > 0, own).otherwise(F.filter(own, lambda x: F.lit(False))))
        orders = F.transform("own", lambda x: F.xxhash64(x["shard"], F.col("hash"), x["copy"], F.lit(SEED)))
        return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("own")).alias("taken"), F.col("own.shard").alias("shards"), orders.alias("orders"))

    def shards(self, docs: DataFrame, key: str) -> DataFrame:
        """docs (with the rows' key) once per copy, with columns mix_shard, mix_copy and mix_order, shuffled within shards.

        Columns of docs with those names are replaced; the key goes.
        """
        docs = docs.drop("mix_shard", "mix_copy", "mix_order")
        other = fresh(docs, "mix_key")
        spread = self.rows.join(self.places, ["slot", "block"]).where("not partial or in_cut")
        order = F.xxhash64("shard", "hash", "copy", F.lit(SEED))
        placed = spread.select(F.col("key").alias(other), F.col("shard").alias("mix_shard"), F.col("copy").alias("mix_copy"), order.alias("mix_order"))
        return docs.join(placed, F.col(key) == F.col(other)).drop(key, other).repartitionByRange("mix_shard", "mix_order").sortWithinPartitions("mix_shard", "mix_order")


def _ranked(scratch: Scratch, df: DataFrame, order: list[str], name: str) -> DataFrame:
    """df with a gapless number from 0 in the given order. No task orders more than its own range."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ordered = scratch.keep(ordered, f"{name}-ordered")
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a row per partition: its size is that of the plan, not of the data
    sums = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    numbered = ordered.withColumn("part", part).join(F.broadcast(sums), "part").withColumn(name, F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + F.col("before"))
    return numbered.drop("at", "part", "before")


def _sources(scratch: Scratch, rows: DataFrame, weights: tuple[int, ...], cap: int) -> DataFrame:
    """slot, name, source_size, target, bits, passes, rest of each source: targets() as a table."""
    stats = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    stats = _ranked(scratch, stats.withColumn("nameless", F.col("source").isNull()), ["nameless", "source"], "slot")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("slot") % len(weights) + 1).cast("int")).cast("long")
    stats = scratch.keep(stats.select("slot", F.col("source").alias("name"), "source_size", "rows", weight.alias("weight")), "stats")
    exact = lambda c: c.cast("decimal(38,0)")
    number = lambda n: F.lit(Decimal(n)).cast("decimal(38,0)")
    limit = exact(F.col("source_size") * cap)

    def above(left: int, whole: int):
        # what a source would get by weight is above its limit
        return exact(number(left) * exact(F.col("weight"))) > exact(limit * number(whole))

    def summed(over) -> tuple[int, int, int, int]:
        r = stats.agg(F.count("*"), F.coalesce(F.sum(exact(F.col("source_size"))), number(0)), F.count_if(over), F.coalesce(F.sum(F.when(over, limit)), number(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))).first()
        return int(r[0]), int(r[1]), int(r[2]), int(r[3]), int(r[4])

    # sums alone come to the driver; the level only rises, so a source once at its limit stays there
    over, seen = F.lit(False), -1
    while True:
        count, total, capped, held, whole = summed(over)
        if capped == seen or not whole:
            break
        seen, left = capped, total - held
        over = above(left, whole)
    most = max(0, min(MOST_BITS, 28 - max(1, count).bit_length()))
    bits = F.least(F.lit(most), F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("rows") / BLOCK_ROWS))))).cast("int")
    full = F.lit(True) if not whole else over
    fair = number(total - held) * exact(F.col("weight"))
    passes = F.when(F.col("source_size") == 0, 0).when(full, cap).otherwise(F.floor(exact(fair) / exact(number(max(1, whole)) * exact(F.col("source_size"))))).cast("int")
    target = F.when(full, limit.cast("double")).otherwise(F.lit(float(Fraction(total - held, max(1, whole)))) * F.col("weight"))
    out = stats.select("slot", "name", "source_size", target.alias("target"), bits.alias("bits"), passes.alias("passes"))
    return scratch.keep(out.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("passes") * F.col("source_size"))), "sources")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, shards: int = SHARDS, cap: int = CAP, seed: int = SEED, scratch: Scratch | None = None, key: str | None = None) -> Mix:
    """Decide the mix of docs (doc_id, text, source).

    A size is the number of words outside ASCII white space, 0 for a null text.
    A null source is one of its own. Null and repeated ids and rows are kept
    apart; rows of one id, size and text may differ in what is taken of them, but
    reruns give the same rows. Wordless documents and sources take nothing. Other
    columns, whatever their names, are not read; an empty table gives an empty mix.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = F.col("source").cast("string")
    rows = docs.select(*([F.col(key).alias("key")] if key else []), F.col("doc_id"), name.alias("source"), size.alias("size"), F.xxhash64(F.lit(seed), "doc_id", "text").alias("hash"), F.monotonically_increasing_id().alias("row"))
    rows = scratch.keep(rows, "rows")
    sources = _sources(scratch, rows, weights, cap)

    # a row's block is the leading bits of its hash: hashes are random, so this is the source's permuted order
    keyed = rows.join(sources, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    block = F.when(F.col("bits") == 0, F.lit(0).cast("long")).otherwise(F.expr("shiftrightunsigned(hash, 64 - bits)"))
    keyed = keyed.withColumn("block", block)
    blocks = scratch.keep(keyed.groupBy("slot", "block").agg(F.sum("size").alias("words"), F.first("passes").alias("passes"), F.first("rest").alias("rest")), "blocks")

    # the partial pass: whole blocks in order while they fit, then rows of the next block, a 2**bits-th of the source;
    # sums of runs of blocks first, then within each run, so no task orders all blocks of a source
    coarse = blocks.withColumn("run", F.shiftright("block", RUN_BITS))
    runs = coarse.groupBy("slot", "run").agg(F.sum("words").alias("words"))
    earlier = Window.partitionBy("slot").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("slot", "run", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("before"))
    running = Window.partitionBy("slot", "run").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    summed = coarse.join(runs, ["slot", "run"]).withColumn("upto", F.sum("words").over(running) + F.col("before")).drop("run", "before")
    summed = scratch.keep(summed, "summed")
    cut = summed.where("upto > rest").groupBy("slot").agg(F.min("block").alias("cut_block"), F.min_by(F.col("rest") - F.col("upto") + F.col("words"), "block").alias("left"))
    edge = keyed.join(cut, "slot").where("block = cut_block").select("slot", "block", "hash", "doc_id", "size", "row", "left")
    edge = scratch.keep(edge.groupBy("slot", "block").applyInPandas(_fitting, "slot long, block long, row long"), "edge")
    inside = edge.select("slot", "row", F.lit(True).alias("inside"))
    decided = keyed.join(inside, ["slot", "row"], "left").withColumn("in_cut", F.coalesce("inside", F.lit(False)))
    decided = scratch.keep(decided.select(*(["key"] if key else []), "doc_id", "size", "source_size", "target", "hash", "slot", "block", "in_cut"), "decided")

    # every block once per pass and once more if the partial pass takes it, whole or cut
    taken = summed.join(cut.select("slot", "cut_block"), "slot", "left").select("slot", "block", "passes", (F.col("upto") <= F.col("rest")).alias("full"), F.coalesce(F.col("block") == F.col("cut_block"), F.lit(False)).alias("cut"))
    extra = F.when(F.col("full"), F.array(F.struct(F.col("passes").alias("copy"), F.lit(False).alias("partial")))).when(F.col("cut"), F.array(F.struct(F.col("passes").alias("copy"), F.lit(True).alias("partial")))).otherwise(F.expr("cast(array() as array<struct<copy: int, partial: boolean>>)"))
    whole = F.when(F.col("passes") > 0, F.transform(F.sequence(F.lit(0), F.col("passes") - 1), lambda i: F.struct(i.alias("copy"), F.lit(False).alias("partial")))).otherwise(F.expr("cast(array() as array<struct<copy: int, partial: boolean>>)"))
    copies = taken.select("slot", "block", F.explode(F.concat(whole, extra)).alias("x")).select("slot", "block", "x.copy", "x.partial")
    # each source's copies in the order of a hash: counts by its leading bits first, then numbers within these
    copies = copies.withColumn("draw", F.xxhash64(F.lit(seed), "slot", "copy", "block")).withColumn("run", F.shiftrightunsigned("draw", 64 - DRAW_BITS))
    counts = copies.groupBy("slot", "run").agg(F.count("*").alias("n"))
    counts = counts.select("slot", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    drawn = Window.partitionBy("slot", "run").orderBy("draw", "copy", "block")
    copies = copies.join(counts, ["slot", "run"]).withColumn("turn", F.row_number().over(drawn) - 1 + F.col("before")).drop("run", "draw", "before")
    copies = scratch.keep(copies, "copies")

    quotas = copies.groupBy("slot").agg(F.count("*").alias("n")).withColumn("group", F.pmod(F.xxhash64("slot"), F.lit(GROUPS)).cast("int"))
    quotas = scratch.keep(quotas, "quotas")
    sums = {r["group"]: r["n"] for r in quotas.groupBy("group").agg(F.sum("n").alias("n")).collect()}  # GROUPS rows at most
    groups = sorted(sums)
    split = split_tree([sums[g] for g in groups], shards, seed)
    sizes = {g: split[:, i].tolist() for i, g in enumerate(groups)}

    def taking(given: pd.DataFrame) -> pd.DataFrame:
        group = int(given["group"].iloc[0])
        return turns(given, group, shards, seed, sizes[group])

    leaves = quotas.groupBy("group").applyInPandas(taking, "slot long, shard int, low long, high long").select("slot", "shard", F.explode(F.sequence("low", "high")).alias("turn"))
    places = scratch.keep(copies.join(leaves, ["slot", "turn"]).select("slot", "block", "copy", "partial", "shard"), "places")
    for name_ in ("rows", "stats", "slot-ordered", "sources", "blocks", "summed", "edge", "copies", "quotas"):
        scratch.discard(name_)
    return Mix(decided, places)
