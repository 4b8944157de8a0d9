"""Repeated passages by collinear chaining of shared k-mer seeds.

Seeds are minimizers of word k-mers. Every seed that several documents hold is
joined to its first place in the least of them, so a passage that many
documents share costs a row per occurrence, not per pair. The anchors of a
document and a pivot are chained in order through a Fenwick tree, with a cost
for the words between them and a limit to the gap; each chain is then aligned
word by word and extended to its passage's ends, and its longest parts that are
long and alike enough are kept. Passages need not be exact copies.

The parts of one passage may have different pivots, none of which holds all of
it. So neighbouring chains of a document that lead to two pivots are joined with
those of the least document that has the same neighbours, and chained again with
it: the two documents that share the whole passage meet.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import textkit
from millrace.llm.scratch import Scratch
from millrace.llm.sieve import marked, passing, sieve

#: Short and dense seeds: 50 words of which 10 are edited have 4 equal ones in a row somewhere.
K, WINDOW = 4, 5
#: Words of a passage at least, and the share of them that must agree.
LEAST_WORDS, LEAST_ALIKE = 50, 0.8
#: Anchors further apart than this are of different passages; the cost of a word between anchors, in either document.
MOST_GAP, GAP_COST = 40, 0.05
#: Words on either side of its chains that a document is first aligned with, and the width of the cells in which neighbouring chains meet.
REACH, CELL = 64, 64
#: How far below its best score an extension may fall.
DROP = 24


def minimizers(hashes: np.ndarray, first: np.ndarray, window: int) -> np.ndarray:
    """Indices of the hashes that are the least (leftmost of equals) of some window of their row; short rows are one window."""
    picked = []
    n = len(hashes)
    if not n:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    if n >= window:
        least = np.lib.stride_tricks.sliding_window_view(hashes, window).argmin(axis=1) + np.arange(n - window + 1)
        inside = row[: n - window + 1] == row[window - 1 :]
        picked.append(np.unique(least[inside]))
    for r in np.flatnonzero((np.diff(first) > 0) & (np.diff(first) < window)).tolist():
        picked.append([first[r] + int(hashes[first[r] : first[r + 1]].argmin())])
    return np.unique(np.concatenate(picked)).astype(np.int64) if picked else np.zeros(0, np.int64)


def _seeds(k: int, window: int):
    schema = pa.schema([("doc_id", pa.int64()), ("seed", pa.list_(pa.int64())), ("at", pa.list_(pa.int32())), ("turn", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = textkit.text_buffers(batch.column("text"))
            for row, end, part, at in textkit.chunks(data, offsets):
                starts, ends, first = textkit.word_spans(part, at)
                words = textkit.span_hashes(part, starts, ends)
                counts = np.diff(first)
                hashes, rows = textkit.shingle_hashes(words, first, k)
                hashes, rows = _without_short(hashes, rows, counts < k)
                best = minimizers(hashes, rows, window)
                owner = np.searchsorted(rows, best, "right") - 1
                values, places = hashes[best].view(np.int64), (best - rows[owner]).astype(np.int32)
                # which of its seed's places in the row each place is, from 0
                order = np.lexsort((places, values, owner))
                fresh = np.ones(len(best), bool)
                fresh[1:] = (values[order[1:]] != values[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
                begins = np.flatnonzero(fresh)
                turn = np.zeros(len(best), np.int32)
                turn[order] = np.arange(len(best)) - np.repeat(begins, np.diff(np.append(begins, len(best))))
                lists = pa.array(np.searchsorted(owner, np.arange(end - row + 1)).astype(np.int32))
                columns = [batch.column("doc_id").slice(row, end - row), *(pa.ListArray.from_arrays(lists, pa.array(x)) for x in (values, places, turn))]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _without_short(hashes: np.ndarray, rows: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    counts = np.diff(rows)
    stays = np.repeat(~short, counts)
    return hashes[stays], np.concatenate([[0], np.cumsum(np.where(short, 0, counts))])


class Fenwick:
    """Greatest values over ranges of places; a place's value may rise and fall."""

    def __init__(self, n: int):
        self.values, self.tree = [-np.inf] * (n + 1), [-np.inf] * (n + 1)

    def put(self, at: int, value: float) -> None:
        """Set the value at a place, from 0 on."""
        i, n, values, tree = at + 1, len(self.tree), self.values, self.tree
        values[i] = value
        while i < n:
            best, step = values[i], 1
            while step < i & -i:
                best = max(best, tree[i - step])
                step <<= 1
            tree[i] = best
            i += i & -i

    def most(self, low: int, high: int) -> float:
        """The greatest value at places low to high, high not included."""
        out, i, values, tree = -np.inf, high, self.values, self.tree
        while i > low:
            if i - (i & -i) >= low:
                out = max(out, tree[i])
                i -= i & -i
            else:
                out = max(out, values[i])
                i -= 1
        return out


def chain_scores(x: np.ndarray, y: np.ndarray, size: np.ndarray, gap_cost: float = GAP_COST, most_gap: int = MOST_GAP, overlap: int = K - 1) -> tuple[list[float], list[int]]:
    """For each anchor the score of the best chain that ends with it, and the anchor before it in that chain or -1.

    An anchor may follow one whose end is neither behind its own start in either
    text (but for `overlap` words) nor more than `most_gap` words before it in
    either; a chain's score is its anchors' words less `gap_cost` for each word
    between two of them, in both texts. The anchors that are near enough in x are
    held in a Fenwick tree over their ends in y, and leave it as x moves on.
    """
    xs, ys, words = x.tolist(), y.tolist(), size.tolist()
    ends = [(a + max(1, n - overlap), b + max(1, n - overlap)) for a, b, n in zip(xs, ys, words, strict=True)]
    places = sorted({e for _, e in ends})
    tree, live = Fenwick(len(places)), [[] for _ in places]
    score, before = [float(n) for n in words], [-1] * len(xs)
    coming = sorted(range(len(xs)), key=lambda i: (ends[i][0], ends[i][1], i))
    into = out = 0
    for a in sorted(range(len(xs)), key=lambda i: (xs[i], ys[i], words[i])):
        # an anchor ends behind its start, so all that end up to here have their score
        while into < len(coming) and ends[coming[into]][0] <= xs[a]:
            b = coming[into]
            at = bisect_left(places, ends[b][1])
            live[at].append((score[b] + gap_cost * (ends[b][0] + ends[b][1]), b))
            tree.put(at, max(live[at])[0])
            into += 1
        while out < into and ends[coming[out]][0] < xs[a] - most_gap:
            b = coming[out]
            at = bisect_left(places, ends[b][1])
            live[at] = [v for v in live[at] if v[1] != b]
            tree.put(at, max(live[at])[0] if live[at] else -np.inf)
            out += 1
        low, high = bisect_left(places, ys[a] - most_gap), bisect_right(places, ys[a])
        best = tree.most(low, high)
        if best - gap_cost * (xs[a] + ys[a]) > 0:
            # of equal ones the nearest in y
            at = next(i for i in range(high - 1, low - 1, -1) if tree.values[i + 1] == best)
            score[a] += best - gap_cost * (xs[a] + ys[a])
            before[a] = max(live[at])[1]
    return score, before


def chains(x: np.ndarray, y: np.ndarray, size: int | np.ndarray, gap_cost: float = GAP_COST, most_gap: int = MOST_GAP, overlap: int | None = None) -> list[list[int]]:
    """The best chains of anchors at (x, y) of so many words each, as lists of their indices in order: each anchor is in one chain at most.

    Anchors may overlap by all but one word of the shortest, if no number is given.
    """
    size = np.broadcast_to(np.asarray(size), x.shape)
    score, before = chain_scores(x, y, size, gap_cost, most_gap, (int(size.min()) - 1 if len(size) else 0) if overlap is None else overlap)
    out, used = [], [False] * len(x)
    for a in sorted(range(len(x)), key=lambda i: (-score[i], int(x[i]), int(y[i]))):
        chain = []
        while a >= 0 and not used[a]:
            used[a] = True
            chain.append(a)
            a = before[a]
        if chain:
            out.append(chain[::-1])
    return out


def blocks(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts in x, starts in y and lengths of the runs that anchors of k words make where they overlap or meet on a diagonal."""
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    begins = np.flatnonzero(np.concatenate([[True], (np.diff(y - x) != 0) | (np.diff(x) > k)]))
    ends = np.append(begins[1:], len(x)) - 1
    return x[begins], y[begins], x[ends] - x[begins] + k


CHAINS = "doc_id long, pivot long, chain array<int>, bx array<int>, by array<int>, size array<int>"
_CHAINS = pa.schema([("doc_id", pa.int64()), ("pivot", pa.int64()), *((n, pa.list_(pa.int32())) for n in ("chain", "bx", "by", "size"))])


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, list[tuple]]]:
    """(key, [the columns' arrays of each part]) of runs of rows with equal keys, which may go over several batches."""
    key, held = None, []
    for batch in batches:
        if not len(batch):
            continue
        named = [batch.column(c).to_numpy() for c in keys]
        change = np.zeros(len(batch), bool)
        for k in named:
            change[1:] |= k[1:] != k[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for b, e in zip(edges[:-1], edges[1:], strict=True):
            if (now := tuple(int(k[b]) for k in named)) != key:
                if held:
                    yield key, held
                key, held = now, []
            held.append(tuple(batch.column(c).slice(b, e - b) for c in columns))
    if held:
        yield key, held


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(schema.types)], schema=schema)
            held = []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], t) for i, t in enumerate(schema.types)], schema=schema)


def _listed(found: list[list[int]], x: np.ndarray, y: np.ndarray, size: np.ndarray, k: int) -> tuple[list[int], ...]:
    """The chains of two seeds or more, one after the other: each block's chain, its place in both and its words."""
    chain, order = [], []
    for c in found:
        if len(c) > 1 or size[c[0]] > k:
            chain += [chain[-1] + 1 if chain else 0] * len(c)
            order += c
    return chain, x[order].tolist(), y[order].tolist(), size[order].tolist()


def _whole_groups(batches: Iterator[pa.RecordBatch], names: tuple[str, str, str, str]) -> Iterator[tuple[np.ndarray, ...]]:
    """The rows in pieces that end where the first two columns change."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        if not len(batch):
            continue
        now = tuple(batch.column(c).to_numpy() for c in names)
        change = np.flatnonzero((now[0][1:] != now[0][:-1]) | (now[1][1:] != now[1][:-1])) + 1
        if held and (held[-1][0][-1] != now[0][0] or held[-1][1][-1] != now[1][0]):
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
        if len(change):
            held.append(tuple(c[: change[-1]] for c in now))
            yield tuple(map(np.concatenate, zip(*held, strict=True)))
            held = []
            now = tuple(c[change[-1] :] for c in now)
        held.append(now)
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def _hopeful(x: np.ndarray, y: np.ndarray, edges: np.ndarray, reach: int) -> np.ndarray:
    """Which groups of anchors, each in order of x, may have a chain of two: some row is followed by one that is near in both texts. Groups of over three always may."""
    size = np.diff(edges)
    out = size > 3
    group = np.repeat(np.arange(len(size)), size)
    for step in (1, 2):
        dx, dy = x[step:] - x[:-step], y[step:] - y[:-step]
        near = (group[step:] == group[:-step]) & (dx > 0) & (dx <= reach) & (dy > 0) & (dy <= reach)
        out[group[:-step][near]] = True
    return out


def _chained(k: int):
    """For each group (doc_id, pivot), whose rows come one after the other: the blocks of its chains of two seeds or more, and each block's chain."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc, pivot, at, pivot_at in _whole_groups(batches, ("doc_id", "pivot", "at", "pivot_at")):
            # in one order, so that ties between chains fall alike in every run
            order = np.lexsort((pivot_at, at, pivot, doc))
            doc, pivot, x, y = doc[order], pivot[order], at[order].astype(np.int64), pivot_at[order].astype(np.int64)
            fresh = np.ones(len(doc), bool)
            other = (doc[1:] != doc[:-1]) | (pivot[1:] != pivot[:-1])
            fresh[1:] = other | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            first = np.concatenate([[True], other])[fresh]
            doc, pivot, x, y = doc[fresh], pivot[fresh], x[fresh], y[fresh]
            edges = np.append(np.flatnonzero(first), len(doc))
            for g in np.flatnonzero(_hopeful(x, y, edges, MOST_GAP + k)).tolist():
                b, e = int(edges[g]), int(edges[g + 1])
                bx, by, size = blocks(x[b:e], y[b:e], k)
                lists = _listed([[0]] if len(bx) == 1 else chains(bx, by, size, overlap=k - 1), bx, by, size, k)
                if lists[0]:
                    yield (int(doc[b]), int(pivot[b]), *lists)

    return lambda batches: _batched(rows(batches), _CHAINS)


BORDERS = "doc_id long, pivot long, second long, cell long, side int, bx array<int>, by array<int>, size array<int>"
_BORDERS = pa.schema([("doc_id", pa.int64()), ("pivot", pa.int64()), ("second", pa.int64()), ("cell", pa.int64()), ("side", pa.int32()), *((n, pa.list_(pa.int32())) for n in ("bx", "by", "size"))])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For neighbouring chains of one document that lead to two pivots: either chain (side 0 and 1) under the pivots and the cells where the first one ends.

    Cells overlap by half, so that ends which differ by a few words share one.
    """

    def rows() -> Iterator[tuple]:
        for (doc,), held in _groups(batches, ("doc_id",), ("pivot", "chain", "bx", "by", "size")):
            own = []
            for pivots, *lists in held:
                for r, pivot in enumerate(pivots.to_pylist()):
                    chain, bx, by, size = (c[r].values.to_numpy() for c in lists)
                    edges = [0, *(np.flatnonzero(np.diff(chain)) + 1).tolist(), len(chain)]
                    own += [(int(bx[b]), int(bx[e - 1] + size[e - 1]), pivot, bx[b:e], by[b:e], size[b:e]) for b, e in zip(edges[:-1], edges[1:], strict=True)]
            own.sort(key=lambda c: (c[0], c[1], c[2]))
            for i, (start, end, pivot, *first) in enumerate(own):
                for later, upto, second, *other in own[i + 1 :]:
                    if later > end + MOST_GAP:
                        break
                    if second != pivot and upto > end and later > start:
                        at = int(first[1][-1] + first[2][-1])
                        for cell in (at // CELL * 2, (at + CELL // 2) // CELL * 2 + 1):
                            for side, chain in enumerate((first, other)):
                                yield (doc, pivot, second, cell, side, *(c.tolist() for c in chain))
                        break

    yield from _batched(rows(), _BORDERS)


def through(a: tuple[list[int], ...], b: tuple[list[int], ...]) -> list[tuple[int, int, int]]:
    """Blocks between two documents, from the blocks (starts, starts in the pivot, lengths) of each with one pivot.

    Either's blocks are those of one chain, so their starts and ends in the pivot ascend: each meets a run of the other's.
    """
    out = []
    starts, ends = b[1], [q + m for q, m in zip(b[1], b[2], strict=True)]
    for x, y, n in zip(*a, strict=True):
        for i in range(bisect_right(ends, y), bisect_left(starts, y + n)):
            low, high = max(y, starts[i]), min(y + n, ends[i])
            out.append((x + low - y, b[0][i] + low - starts[i], high - low))
    return out


def _rechained(k: int):
    """The chains of a document with the least one that has the same neighbouring chains, through both pivots. Groups as in _chained."""
    columns = ("bx", "by", "size", "other_bx", "other_by", "other_size")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, held in _groups(batches, ("doc_id", "pivot"), columns):
            met = set()
            for part in held:
                for r in zip(*(c.to_pylist() for c in part), strict=True):
                    met.update(through(r[:3], r[3:]))
            if not met:
                continue
            x, y, size = np.array(sorted(met), np.int64).T
            # blocks of one diagonal that touch or overlap are one; short remains are no seeds
            order = np.lexsort((x, y - x))
            merged: list[list[int]] = []
            for p, q, e in zip(x[order].tolist(), y[order].tolist(), (x + size)[order].tolist(), strict=True):
                if merged and merged[-1][1] - merged[-1][0] == q - p and p <= merged[-1][2]:
                    merged[-1][2] = max(merged[-1][2], e)
                else:
                    merged.append([p, q, e])
            x, y, size = np.array([(p, q, e - p) for p, q, e in merged if e - p >= k] or [(0, 0, 0)], np.int64).T
            if size[0]:
                lists = _listed(chains(x, y, size, overlap=k - 1), x, y, size, k)
                if lists[0]:
                    yield (*key, *lists)

    return lambda batches: _batched(rows(batches), _CHAINS)


def _extend(a: np.ndarray, b: np.ndarray) -> tuple[int, bool]:
    """How many words of both, from their beginnings on, raise the score most (1 for equal words, -2 for others, until it has fallen by DROP), and whether more of a could tell."""
    n = min(len(a), len(b))
    best = where = 0
    at, total = 0, 0
    while at < n:
        step = np.cumsum(np.where(a[at : min(at + 256, n)] == b[at : min(at + 256, n)], 1, -2)) + total
        high = np.maximum(np.maximum.accumulate(step), best)
        low = np.flatnonzero(step < high - DROP)
        end = int(low[0]) if len(low) else len(step)
        if end and high[end - 1] > best:
            best = int(high[end - 1])
            where = at + int(step[:end].argmax()) + 1
        if len(low):
            return where, False
        total = int(step[-1])
        at += 256
    return where, n == len(a)


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many words both begin with."""
    n = min(len(a), len(b))
    other = np.flatnonzero(a[:n] != b[:n])
    return int(other[0]) if len(other) else n


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Words of a longest common subsequence."""
    places: dict[int, int] = {}
    for j, w in enumerate(b.tolist()):
        places[w] = places.get(w, 0) | 1 << j
    full = state = (1 << len(b)) - 1
    for w in a.tolist():
        hit = state & places.get(w, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(b) - state.bit_count()


def _runs(a: np.ndarray, b: np.ndarray, at: int, other: int) -> list[tuple[int, int, int]]:
    """The runs of equal words of two texts of one length, as blocks from (at, other) on."""
    same = np.concatenate([[0], (a == b).astype(np.int8), [0]])
    edges = np.flatnonzero(np.diff(same)).tolist()
    return [(at + s, other + s, e - s) for s, e in zip(edges[::2], edges[1::2], strict=True)]


def aligned(x: np.ndarray, y: np.ndarray, chain: list[tuple[int, int, int]], before: bool = False, after: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Starts in x and y and lengths of a chain's runs of equal words, extended beyond its ends, and the words that agree up to each run's end.

    before and after: whether x goes on there, unseen; none if these words could change the result.
    """
    first, last = chain[0], chain[-1]
    back, more = _extend(x[: first[0]][::-1], y[: first[1]][::-1])
    if more and before:
        return None
    s, t = last[0] + last[2], last[1] + last[2]
    ahead, more = _extend(x[s:], y[t:])
    if more and after:
        return None
    todo = _runs(x[first[0] - back : first[0]], y[first[1] - back : first[1]], first[0] - back, first[1] - back) + chain + _runs(x[s : s + ahead], y[t : t + ahead], s, t)
    runs: list[list[int]] = []
    total, upto = 0, []
    for i, j, n in todo:
        if runs:
            p, q, m = runs[-1]
            cut = max(0, p + m - i, q + m - j)
            i, j, n = i + cut, j + cut, n - cut
            if n <= 0:
                continue
            # the words between: equal ones that follow the run before or precede this one belong to them
            more = _equal(x[p + m : i], y[q + m : j])
            runs[-1][2], upto[-1], total = m + more, upto[-1] + more, total + more
            p, q = p + m + more, q + m + more
            less = _equal(x[p:i][::-1], y[q:j][::-1])
            i, j, n = i - less, j - less, n + less
            if (p, q) == (i, j):
                runs[-1][2], upto[-1], total = runs[-1][2] + n, upto[-1] + n, total + n
                continue
            total += _common(x[p:i], y[q:j])
        runs.append([i, j, n])
        total += n
        upto.append(total)
    return *np.array(runs, np.int64).T, np.array(upto, np.int64)


def split(bx: np.ndarray, by: np.ndarray, size: np.ndarray, upto: np.ndarray, least_words: int, least_alike: float) -> list[tuple[int, int, float]]:
    """(first run, last run, share that agrees) of the passages of an alignment: the longest part that is long and alike enough, then those on either side of it."""
    out, todo = [], [(0, len(bx))]
    while todo:
        low, high = todo.pop()
        if low >= high or min(bx[high - 1] - bx[low], by[high - 1] - by[low]) + size[high - 1] < least_words:
            continue
        best = (0, -1, -1, 0.0)
        for i in range(low, high):
            across, down = bx[i:high] + size[i:high] - bx[i], by[i:high] + size[i:high] - by[i]
            if max(int(across[-1]), int(down[-1])) <= best[0]:
                break
            share = (upto[i:high] - (upto[i] - size[i])) / np.maximum(across, down)
            good = np.flatnonzero((np.minimum(across, down) >= least_words) & (share >= least_alike))
            if len(good) and (long := int(max(across[good[-1]], down[good[-1]]))) > best[0]:
                best = (long, i, i + int(good[-1]), float(share[good[-1]]))
        if best[0]:
            out.append(best[1:])
            todo += [(low, best[1]), (best[2] + 1, high)]
    return sorted(out)


PARTS = "doc_id long, pivot long, chain array<int>, bx array<int>, by array<int>, size array<int>, whole int, at array<int>, part array<array<int>>"
_PARTS = pa.schema([*_CHAINS, ("whole", pa.int32()), ("at", pa.list_(pa.int32())), ("part", pa.list_(pa.list_(pa.int32())))])


def _cut(reach: int):
    """Of each row's document x, the words around its chains, `reach` on either side: parts that touch are one."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            lists = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("chain", "bx", "by", "size", "x")}
            for r, (doc, pivot) in enumerate(zip(batch.column("doc_id").to_pylist(), batch.column("pivot").to_pylist(), strict=True)):
                chain, bx, by, size, x = (v[o[r] : o[r + 1]] for o, v in lists.values())
                edges = [0, *(np.flatnonzero(np.diff(chain)) + 1).tolist(), len(chain)]
                spans: list[list[int]] = []
                for low, high in sorted((max(0, int(bx[b]) - reach), min(len(x), int(bx[e - 1] + size[e - 1]) + reach)) for b, e in zip(edges[:-1], edges[1:], strict=True)):
                    if spans and low <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], high)
                    else:
                        spans.append([low, high])
                yield doc, pivot, chain, bx, by, size, len(x), [s for s, _ in spans], [x[s:e] for s, e in spans]

    return lambda batches: _batched(rows(batches), _PARTS, 200)


def _aligned(least_words: int, least_alike: float):
    """The passages of each row's chains; a single row of start -1 where the parts of x don't suffice to tell."""
    names = ("doc_id", "start", "end", "other_id", "other_start", "other_end")
    schema = pa.schema([*((n, pa.int64()) for n in names), ("alike", pa.float64())])

    def passages(x: list[np.ndarray], at: list[int], whole: int, y: np.ndarray, chained: list[tuple[int, int, int]], edges: list[int]) -> list[tuple] | None:
        found: list[tuple[int, int, int, int, float]] = []
        for b, e in zip(edges[:-1], edges[1:], strict=True):
            # a chain within a passage that is found tells nothing new
            (s, ps, _), (i, j, n) = chained[b], chained[e - 1]
            if any(f[0] <= s and i + n <= f[1] and f[2] <= ps and j + n <= f[3] for f in found):
                continue
            part = bisect_right(at, s) - 1
            low, words = at[part], x[part]
            runs = aligned(words, y, [(p - low, q, m) for p, q, m in chained[b:e]], low > 0, low + len(words) < whole)
            if runs is None:
                return None
            bx, by, size, upto = runs
            for first, last, share in split(bx, by, size, upto, least_words, least_alike):
                p = (low + int(bx[first]), low + int(bx[last] + size[last]), int(by[first]), int(by[last] + size[last]))
                if not any(f[0] <= p[0] and p[1] <= f[1] and f[2] <= p[2] and p[3] <= f[3] for f in found):
                    found.append((*p, share))
        return found

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            lists = {c: (batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy()) for c in ("y", "chain", "bx", "by", "size", "at")}
            parts = batch.column("part")
            for r, (doc, pivot, whole) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "pivot", "whole")), strict=True)):
                y, chain, *places, at = (v[o[r] : o[r + 1]] for o, v in lists.values())
                inner = parts[r].values
                cuts, words = inner.offsets.to_numpy(), inner.values.to_numpy()
                x = [words[b:e] for b, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
                chained = list(zip(*(p.tolist() for p in places), strict=True))
                edges = [0, *(np.flatnonzero(np.diff(chain)) + 1).tolist(), len(chain)]
                found = passages(x, at.tolist(), whole, y, chained, edges)
                if found is None:
                    yield doc, -1, -1, pivot, -1, -1, 0.0
                else:
                    yield from ((doc, s, e, pivot, ps, pe, share) for s, e, ps, pe, share in found)

    return lambda batches: _batched(rows(batches), schema)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("words", pa.list_(pa.int32()))])
    for batch in batches:
        data, offsets = textkit.text_buffers(batch.column("text"))
        for row, end, part, at in textkit.chunks(data, offsets):
            starts, ends, first = textkit.word_spans(part, at)
            values = (textkit.span_hashes(part, starts, ends) >> np.uint64(32)).astype(np.uint32).view(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(row, end - row), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values))], schema=schema)


def _single(source: DataFrame, scratch: Scratch) -> DataFrame:
    """source (doc_id, text) with one row per id: that whose text has the least hash. Rows whose id doesn't repeat aren't shuffled."""
    twice = scratch.keep(source.groupBy("doc_id").agg(F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("least")).where("n > 1").select(F.col("doc_id").alias("id"), "least"), "twice")
    if twice.isEmpty():
        return source
    told = marked(source, "doc_id", sieve(twice, "id"), "may")
    met = told.where("may").join(twice.hint("merge"), F.col("doc_id") == F.col("id"), "left")
    repeated = met.where(F.xxhash64("text") == F.col("least")).groupBy("doc_id").agg(F.min("text").alias("text"))
    return told.where("not may").select("doc_id", "text").union(met.where("id is null").select("doc_id", "text")).union(repeated)


def repeats(docs: DataFrame, least_words: int = LEAST_WORDS, least_alike: float = LEAST_ALIKE, k: int = K, window: int = WINDOW) -> DataFrame:
    """doc_id, start, end, other_id, other_start, other_end, alike: passages that a document shares with a lesser one.

    Positions are words (split at ASCII white space, A-Z lower-cased), ends
    exclusive. Passages of fewer than `least_words` words and those whose best
    alignment matches less than `least_alike` of the longer side don't count.
    Every occurrence is listed against the least document that holds its seeds, or
    the least that has the same neighbouring ones, so copies are linked through it
    and not in all pairs. Null ids and texts share nothing; rows of one id are one
    document, of which the text with the least hash counts; an empty table gives an
    empty result; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "passages")
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    source = _single(given, scratch)
    held = scratch.keep(source.mapInArrow(_seeds(k, window), "doc_id long, seed array<long>, at array<int>, turn array<int>"), "seeds")
    places = held.select("doc_id", F.explode(F.arrays_zip("seed", "at", "turn")).alias("z")).select("doc_id", "z.seed", "z.at", "z.turn")

    # of each shared seed, the least document and its first place there; shuffled alike at every size
    firsts = places.where("turn = 0")
    least = [F.min("doc_id").alias("pivot"), F.max("doc_id").alias("last"), F.min_by("at", "doc_id").alias("pivot_at")]
    # written first: a join of two plain exchanges is one whose hot seeds Spark can split
    shared = scratch.keep(firsts.groupBy("seed").agg(*least).where("pivot < last").select("seed", "pivot", "pivot_at"), "shared")
    met = places.join(shared.hint("merge"), "seed").where("doc_id <> pivot").select("doc_id", "pivot", "at", "pivot_at")
    # later places of one seed (a repeated word or line) go to the least document that has as many, and to the pivot's first place as well
    later = places.where("turn > 0")
    longer = scratch.keep(later.groupBy("seed", "turn").agg(*least).where("pivot < last").select("seed", "turn", "pivot", "pivot_at"), "longer")
    turns = later.join(longer.hint("merge"), ["seed", "turn"]).where("doc_id <> pivot").select("doc_id", "pivot", "at", "pivot_at")
    anchors = met.union(turns)

    dealt = anchors.repartition("doc_id", "pivot").sortWithinPartitions("doc_id", "pivot")
    found = scratch.keep(dealt.mapInArrow(_chained(k), CHAINS), "chains")
    for name in ("seeds", "shared", "longer"):
        scratch.discard(name)

    # neighbouring chains to two pivots: the least document with the same ones is a partner, too
    borders = scratch.keep(found.repartition("doc_id").sortWithinPartitions("doc_id").mapInArrow(_borders, BORDERS), "borders")
    where = ["pivot", "second", "cell", "side"]
    blocks_ = F.struct(F.col("bx").alias("other_bx"), F.col("by").alias("other_by"), F.col("size").alias("other_size"))
    partner = borders.groupBy(*where).agg(F.min("doc_id").alias("partner"), F.max("doc_id").alias("last"), F.min(F.struct("doc_id", blocks_.alias("b"))).alias("m")).where("partner < last")
    partner = scratch.keep(partner.select(*where, "partner", "m.b.*"), "partners")
    both = borders.join(partner.hint("merge"), where).where("doc_id <> partner").select("doc_id", F.col("partner").alias("pivot"), "bx", "by", "size", "other_bx", "other_by", "other_size")
    again = both.repartition("doc_id", "pivot").sortWithinPartitions("doc_id", "pivot").mapInArrow(_rechained(k), CHAINS)
    again = scratch.keep(again, "again")
    for name in ("borders", "partners"):
        scratch.discard(name)
    found = found.union(again)

    # the words of documents with chains, by id; a sieve keeps other texts from the shuffle
    def words(ids: DataFrame, name: str) -> DataFrame:
        near = passing(source, "doc_id", sieve(ids, "doc_id"))
        return near.mapInArrow(_words, "doc_id long, words array<int>").withColumnRenamed("words", name)

    columns = "doc_id long, start long, end long, other_id long, other_start long, other_end long, alike double"

    def judged(chained: DataFrame, reach: int, name: str) -> DataFrame:
        parts = chained.join(words(chained, "x").hint("merge"), "doc_id").mapInArrow(_cut(reach), PARTS)
        pivots = words(chained.select(F.col("pivot").alias("doc_id")), "y").withColumnRenamed("doc_id", "pivot")
        return scratch.keep(parts.join(pivots.hint("merge"), "pivot").mapInArrow(_aligned(least_words, least_alike), columns), name)

    near = judged(found, REACH, "near")
    # alignments that go beyond the words at hand are made with whole documents
    beyond = near.where("start < 0").select("doc_id", F.col("other_id").alias("pivot")).distinct()
    out = near.where("start >= 0")
    if not beyond.isEmpty():
        wide = scratch.keep(found.join(beyond, ["doc_id", "pivot"], "left_semi"), "wide")
        out = out.union(judged(wide, 1 << 30, "far"))
    out = scratch.keep(out.distinct(), "passages")
    for name in ("chains", "again", "near", "wide", "far"):
        scratch.discard(name)
    return out
