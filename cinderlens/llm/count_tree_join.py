"""N-gram Jaccard join by a forest of count-vector R-trees.

A text's distinct word n-grams are hashed into groups, and the counts by group are the coordinates of its point. Texts
with equal sets are one vertex. Of two texts with Jaccard similarity p/q or more and x and y n-grams, at most
D = floor((x + y)(q - p) / (q + p)) n-grams are in one of them only, so their points differ by at most D in sum. The
coordinates are dealt to blocks, and each n-gram belongs to one block: the two points agree on all coordinates of all but
D blocks. The top level of the index is therefore a hash of (size band, block, the block's coordinates), its cells. If
all cells are put into one order, the first cell that two similar texts share is among the first D + 1 of either, so
these are all that a text needs. The order is by how many n-grams a block holds, most first, so that cells of one or no
n-gram, in which unlike texts meet, are left out. Bands double in size; a text that can have a partner in the next band
is put into cells of both. Below that level cells are R-trees: boxes of points, whose overlap with a point is bounded by
the summed minima of coordinates. Survivors are verified with the n-grams themselves.

Only classes of linked texts are wanted. A cell first pairs each member with one of them (after each task has done so for
its own members, which keeps a frequent cell to one row per task); these pairs are verified, first one for each text and
then those that still lie in different classes. Cells whose members then are in different classes are searched with the
tree, twice for pairs that make a forest of the classes (so a cell asks for fewer pairs than it has members), then for one
partner of each member in each other class and at last for all remaining pairs across classes, so no link between classes
is lost. A cell in which the tree leaves no pair for a forest is done, as classes only grow. Large cells are cut into chunks
and searched chunk by chunk. Most links come from the cells and their first pairs; the trees settle the mixed cells. Sets are
large and points are small, so pairs that points rule out are told by these, and only the others meet their sets.

Defined results: A-Z are lower-cased and words are runs of characters other than 0x20 and 0x09-0x0D; a text of fewer
words than n has its whole sequence as its one n-gram; null and empty texts have none and are linked with nothing;
rows with one id and different texts are one vertex of the classes, which links all their partners; null ids are linked
with nothing and have a null class in the report, while ``keep_one`` tells rows apart by all their columns, so rows
without an id are removed as copies like any others; repeated and very long texts follow the same path; an empty table
gives an empty result. N-grams are dealt to cells and sets told apart by 64-bit hashes; pairs are verified with the upper 48
bits of those of the n-grams.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinderlens.llm.components import components
from cinderlens.llm.rows import ROW, anti_join, maybe_join, semi_join, with_row_key
from cinderlens.llm.scratch import bucketed, durable, release
from cinderlens.llm.text import WordHasher, give_back, gram_hashes, mix, slices, utf8

#: Coordinates of one block in the index's top level.
BLOCK_GROUPS = 1024
#: Coordinates of the points in the trees.
TREE_GROUPS = 256
#: Points of a leaf and boxes of a node.
FANOUT = 16
#: Members of a cell that one task searches at once.
CHUNK = 2048
#: Smallest cells of a member that its rows carry, to report a pair in one of its cells only.
LOW_CELLS = 8
#: Cell rows that a task holds before it combines them.
HELD_ROWS = 750_000
#: Pairs of points that are bounded at once, and pairs of leaves whose points are paired at once.
AT_ONCE = 4096
LEAVES_AT_ONCE = 1024

#: Passes over forests of the classes, before those over more pairs.
FORESTS = 2
NEAREST, EVERY = -1, -2

DOCUMENT, MEMBER, PAIR = 0, 1, 2


class Shingler:
    """Distinct n-gram hashes of texts, sorted."""

    def __init__(self, n: int):
        self.n = n
        self.hasher = WordHasher()

    def set_of(self, text: bytes) -> np.ndarray:
        h = self.hasher.of(text)[0]
        if not len(h):
            return h
        out = gram_hashes(h, min(self.n, len(h)))
        out.sort()
        return out[np.concatenate([[True], out[1:] != out[:-1]])]


class Bands:
    """The cells of texts for a similarity of p / q. Band b holds the sizes from 2**b to 2**(b + 1) - 1."""

    def __init__(self, p: int, q: int):
        self.p, self.q = p, q

    def apart(self, size: int, most: int) -> int:
        """How many n-grams at most a text of this size and a similar one of at most this many do not share."""
        return (size + min(most, size * self.q // self.p)) * (self.q - self.p) // (self.q + self.p)

    def blocks(self, band: int) -> int:
        """A quarter more than the largest text of the band needs, so that poor cells can be left out."""
        largest = 2 ** (band + 1) - 1
        return (self.apart(largest, largest) + 1) * 5 // 4 + 2

    def cells(self, shingles: np.ndarray) -> np.ndarray:
        """The keys of the cells that a text belongs to."""
        size = len(shingles)
        band = size.bit_length() - 1
        out = self._keys(shingles, band)
        if size * self.q // self.p >= 2 ** (band + 1):
            out = np.concatenate([out, self._keys(shingles, band + 1)])
        return out

    def _keys(self, shingles: np.ndarray, band: int) -> np.ndarray:
        m = self.blocks(band)
        # the shingles are sorted, so those of a block stand together
        block = ((shingles >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        ends = np.searchsorted(block, np.arange(m + 1, dtype=np.uint64))
        # the sum over n-grams of a number for each group stands for the counts by group
        upto = np.zeros(len(shingles) + 1, np.uint64)
        np.cumsum(mix((block << np.uint64(20)) + shingles % np.uint64(BLOCK_GROUPS)), out=upto[1:])
        keys = mix((upto[ends[1:]] - upto[ends[:-1]]) ^ mix(np.arange(m, dtype=np.uint64) + (np.uint64(band) << np.uint64(40))))
        needed = self.apart(len(shingles), 2 ** (band + 1) - 1) + 1
        poor = (np.uint64(0xFFFF) - np.minimum(np.diff(ends), 0xFFFF).astype(np.uint64) << np.uint64(48)) | (keys >> np.uint64(16))
        # all of the last place are taken, so that the choice depends on the cells alone
        return keys[poor <= np.partition(poor, needed - 1)[needed - 1]]


def point_of(shingles: np.ndarray) -> np.ndarray:
    """Counts by tree group."""
    return np.bincount(((shingles >> np.uint64(24)) % np.uint64(TREE_GROUPS)).astype(np.int64), minlength=TREE_GROUPS).astype(np.int32)


class CountTree:
    """An R-tree over count vectors, packed in order of size. ``levels[0]`` are the points, the last one the root's boxes;
    a box is kept as its upper corner and the smallest size in it."""

    def __init__(self, points: np.ndarray):
        self.order = np.lexsort((points[:, 0], points.sum(1)))
        upper = points[self.order]
        least = upper.sum(1)
        self.levels = [(upper, least)]
        while len(upper) > FANOUT:
            starts = np.arange(0, len(upper), FANOUT)
            upper, least = np.maximum.reduceat(upper, starts), np.minimum.reduceat(least, starts)
            self.levels.append((upper, least))

    def level(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        return self.levels[min(k, len(self.levels) - 1)]


def tree_join(a: CountTree, b: CountTree, p: int, q: int, wanted) -> tuple[np.ndarray, np.ndarray]:
    """Places (in the given orders of points) of the pairs whose overlap may reach what a similar pair needs. Both trees
    are gone down together: a pair of boxes is followed if the summed minima of their upper corners reach what the
    smallest texts in them would need. ``wanted(i, j)`` says which pairs of points are asked for at all."""
    top = max(len(a.levels), len(b.levels)) - 1
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(a.level(top)[0])), np.arange(len(b.level(top)[0])), indexing="ij"))
    sizes = lambda k: (len(a.level(k)[0]) if k < len(a.levels) - 1 else 0, len(b.level(k)[0]) if k < len(b.levels) - 1 else 0)
    for k in range(top, 0, -1):
        meets = _meets(a.level(k), b.level(k), i, j, p, q)
        i, j = i[meets], j[meets]
        if k > 1:
            i, j = _children(i, j, *sizes(k - 1))
    found = []
    for s in range(0, len(i), LEAVES_AT_ONCE):
        x, y = i[s : s + LEAVES_AT_ONCE], j[s : s + LEAVES_AT_ONCE]
        if top:
            x, y = _children(x, y, *sizes(0))
        asked = wanted(a.order[x], b.order[y])
        x, y = x[asked], y[asked]
        meets = _meets(a.level(0), b.level(0), x, y, p, q)
        found.append((a.order[x[meets]], b.order[y[meets]]))
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)])


def _meets(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], i: np.ndarray, j: np.ndarray, p: int, q: int) -> np.ndarray:
    """Whether the bound on the overlap of two points or boxes reaches what a similar pair of their least sizes needs."""
    out = np.zeros(len(i), bool)
    for s in range(0, len(i), AT_ONCE):
        x, y = i[s : s + AT_ONCE], j[s : s + AT_ONCE]
        bound = np.minimum(a[0][x], b[0][y]).sum(1)
        out[s : s + AT_ONCE] = (p + q) * bound >= p * (a[1][x] + b[1][y])
    return out


def _children(i: np.ndarray, j: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children; a side with 0 has no level here and stays as it is."""
    for first in (True, False):
        own, other, n = (i, j, n_a) if first else (j, i, n_b)
        if n:
            child = (own[:, None] * FANOUT + np.arange(FANOUT)).ravel()
            other = np.repeat(other, FANOUT)[child < n]
            child = child[child < n]
            i, j = (child, other) if first else (other, child)
    return i, j


def _runs(keys: np.ndarray) -> np.ndarray:
    """Starts of runs of equal keys, and the end."""
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)


_NAMES = ["kind", "key", "a", "b", "c"]
_SCHEMA = "kind byte, key long, a long, b long, c long"


def _rows(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray | None = None) -> pa.RecordBatch:
    c = np.zeros(len(key), np.int64) if c is None else c
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int8)), pa.array(key.view(np.int64)), pa.array(a), pa.array(b), pa.array(c)], _NAMES)


def _star(keys: np.ndarray, ids: np.ndarray) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """Members sorted by key and id: one member row per cell, and its pairs with the other members."""
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    starts = _runs(keys)
    pivot = np.repeat(ids[starts[:-1]], np.diff(starts))
    other = pivot != ids
    first = starts[:-1]
    return _rows(MEMBER, keys[first], ids[first], np.zeros(len(first), np.int64)), _rows(PAIR, keys[other], pivot[other], ids[other])


def cell_rows(rows: DataFrame, n: int, p: int, q: int) -> DataFrame:
    """``kind, key, a, b, c`` from ``row, text``: the rows (a: row, b: number of n-grams, c: the set's hash), and pairs of
    sets (a, b) that met in a cell. Of equal sets in one task only the first goes through the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, bands = Shingler(n), Bands(p, q)
        seen: set[int] = set()
        keys: list[np.ndarray] = []
        marks: list[np.ndarray] = []
        held = 0
        for batch in slices(batches):
            row = batch.column(0).to_numpy()
            sizes, own = np.zeros(len(row), np.int64), np.zeros(len(row), np.int64)
            for i, text in enumerate(utf8(batch.column(1))):
                shingles = shingler.set_of(text)
                sizes[i] = len(shingles)
                own[i] = mark = mark_of(shingles)
                if not len(shingles) or mark in seen:
                    continue
                seen.add(mark)
                cells = bands.cells(shingles)
                keys.append(cells)
                marks.append(np.full(len(cells), mark))
                held += len(cells)
            yield _rows(DOCUMENT, mix(row.view(np.uint64)), row, sizes, own)
            if held >= HELD_ROWS:
                yield from _star(np.concatenate(keys), np.concatenate(marks))
                keys, marks, held = [], [], 0
        if keys:
            yield from _star(np.concatenate(keys), np.concatenate(marks))
        keys, marks = [], []
        give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, pivot = None, None
        for batch in batches:
            kind = batch.column(0).to_numpy()
            passing = kind != MEMBER
            if passing.any():
                yield batch.filter(pa.array(passing))
            key, a = batch.column(1).to_numpy()[~passing], batch.column(2).to_numpy()[~passing]
            if not len(key):
                continue
            starts = _runs(key)
            pivots = a[starts[:-1]].copy()
            if last == key[0]:
                pivots[0] = pivot
            every = np.repeat(pivots, np.diff(starts))
            other = every != a
            last, pivot = key[-1], pivots[-1]
            if other.any():
                yield _rows(PAIR, key[other], np.minimum(every[other], a[other]), np.maximum(every[other], a[other]))
        give_back()

    return rows.mapInArrow(run, _SCHEMA).repartition("key").sortWithinPartitions("key", "a").mapInArrow(meet, _SCHEMA)


def mark_of(shingles: np.ndarray) -> int:
    """A hash of a set, as a signed number; 0 for the empty one."""
    return int.from_bytes(xxhash.xxh3_128_digest(shingles.tobytes())[:8], signed=True) if len(shingles) else 0


def packed(shingles: np.ndarray) -> bytes:
    """The upper 48 bits of sorted hashes, six bytes each: what sets are verified with."""
    return (shingles >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    """The hashes of ``packed``, whose lower 16 bits are 0."""
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def sets_of(rows: DataFrame, n: int) -> DataFrame:
    """``mark, shingles`` (packed) from ``row, text``, one row per set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for batch in slices(batches):
            sets = [shingler.set_of(t) for t in utf8(batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([mark_of(x) for x in sets], pa.int64()), pa.array([packed(x) for x in sets], pa.binary())], ["mark", "shingles"])

    return rows.mapInArrow(run, "mark long, shingles binary").groupBy("mark").agg(F.first("shingles").alias("shingles"))


def points_of(sets: DataFrame) -> DataFrame:
    """``mark, point``: the counts by tree group, packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = [zlib.compress(point_of(unpacked(x)).astype("<i4").tobytes(), 1) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(points, pa.binary())], ["mark", "point"])

    return sets.select("mark", "shingles").mapInArrow(run, "mark long, point binary")


def not_ruled_out(pairs: DataFrame, points: DataFrame, p: int, q: int) -> DataFrame:
    """``a, b, possible`` of the pairs: whether the bound by summed minima leaves them. The points stand in buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            possible = [_possible(*(np.frombuffer(zlib.decompress(v), "<i4") for v in xy), p, q) for xy in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(possible, pa.bool_())], ["a", "b", "possible"])

    side = lambda c, s: points.select(F.col("mark").alias(c), F.col("point").alias(s))
    both = side("a", "pa").join(pairs.select("a", "b").hint("merge"), "a").hint("merge").join(side("b", "pb"), "b")
    return both.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long, possible boolean")


def verify(pairs: DataFrame, sets: DataFrame, p: int, q: int) -> DataFrame:
    """``a, b, linked`` of the pairs: those that pass the bound by summed minima are verified with their n-grams. The sets
    stand in buckets and stay there; only the pairs are moved, with one set each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            linked = [_similar(unpacked(x), unpacked(y), p, q) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    side = lambda c, s: sets.select(F.col("mark").alias(c), F.col("shingles").alias(s))
    both = side("a", "sa").join(pairs.select("a", "b").hint("merge"), "a").hint("merge").join(side("b", "sb"), "b")
    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long, linked boolean")


def _similar(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    """Whether two sorted sets are similar: first by the bound of their count vectors, then by their n-grams."""
    if not _possible(point_of(x), point_of(y), p, q):
        return False
    common = len(np.intersect1d(x, y, assume_unique=True))
    return common * q >= (len(x) + len(y) - common) * p


def _possible(x: np.ndarray, y: np.ndarray, p: int, q: int) -> bool:
    """Whether the bound on the overlap of two points reaches what a similar pair needs."""
    return (p + q) * int(np.minimum(x, y).sum()) >= p * (int(x.sum()) + int(y.sum()))


def forest(a: np.ndarray, b: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Which pairs of classes are taken so that they join all that the pairs join, without a circle. Each class takes its
    first pair by ``order``, and those that meet become one, until no pair lies across."""
    names, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    rank = np.empty(len(a), np.int64)
    rank[np.argsort(order, kind="stable")] = np.arange(len(a))
    at = np.argsort(rank)
    u, v = ends[: len(a)][at], ends[len(a) :][at]
    taken, every = np.zeros(len(a), bool), np.arange(len(names))
    live = np.flatnonzero(u != v)
    while len(live):
        first = np.full(len(names), len(a))
        np.minimum.at(first, u[live], live)
        np.minimum.at(first, v[live], live)
        own = np.flatnonzero(first < len(a))
        taken[at[first[own]]] = True
        to = every.copy()
        to[own] = u[first[own]] + v[first[own]] - own
        # of two that took the same pair one is the root
        to = np.where((to[to] == every) & (every < to), every, to)
        while (to[to] != to).any():
            to = to[to]
        u, v = to[u], to[v]
        live = live[u[live] != v[live]]
    return taken


def forest_pairs(members: DataFrame, p: int, q: int, turn: int) -> DataFrame:
    """``key, a, b``: of the pairs of each cell a forest of the classes, in an order that depends on ``turn``."""
    return _cell_pairs(members, p, q, turn)


def remaining_pairs(members: DataFrame, p: int, q: int, nearest: bool) -> DataFrame:
    """All pairs of the cells. With ``nearest``, a member only gets the first one of each other class."""
    return _cell_pairs(members, p, q, NEAREST if nearest else EVERY).select("a", "b").distinct()


def _cell_pairs(members: DataFrame, p: int, q: int, kind: int) -> DataFrame:
    """``key, a, b``: pairs of members of one cell that lie in different classes and that the cell's tree does not rule out.
    ``members``: ``key, id, label, point``.

    A cell of more than ``CHUNK`` members is cut into chunks by a hash of the id; each pair of chunks is a cell of its
    own, in which only members of different chunks are compared. A pair that meets in several cells is reported by the
    smallest one. Each member's rows carry its smallest cells: if two members have one of these in common, the smallest
    of them is the smallest cell that they share at all; otherwise all their cells report the pair. Forests are reported by
    each cell."""
    if kind in (NEAREST, EVERY):
        members = members.join(members.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, LOW_CELLS).alias("low")), "id")
    else:
        members = members.withColumn("low", F.array().cast("array<long>"))
    # a row for each CHUNK members at most
    large = members.groupBy("key").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks")).where("chunks > 1")
    dealt = members.join(F.broadcast(large), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    dealt = dealt.select("key", "id", "label", "point", "low", "own", other.alias("other")).select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "id", "label", "point", "low"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            cell = np.stack([held[c].to_numpy() for c in ("key", "i", "j")], 1)
            starts = _runs_of_rows(cell)
            yield from search(held.slice(0, starts[-2]), starts[:-1])
            held = held.slice(starts[-2])
        if held is not None and held.num_rows:
            yield from search(held, np.array([0, held.num_rows]))
        held = None
        give_back()

    def search(table: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        keys, i, j, own = (table[c].to_numpy() for c in ("key", "i", "j", "own"))
        ids, labels = table["id"].to_numpy(), table["label"].to_numpy()
        points = np.stack([np.frombuffer(zlib.decompress(x), "<i4") for x in table["point"].to_pylist()])
        low = table["low"].combine_chunks()
        low_ends, low_keys = low.offsets.to_numpy() - low.offsets[0].as_py(), low.flatten().to_numpy()
        smallest = lambda x: low_keys[low_ends[x] : low_ends[x + 1]]
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if len(np.unique(labels[s:e])) < 2:
                continue
            every = np.arange(s, e)
            alone = i[s] == j[s]
            left, right = (every, every) if alone else (every[own[s:e] == i[s]], every[own[s:e] == j[s]])
            if not len(left) or not len(right):
                continue
            tree = CountTree(points[left])
            wanted = lambda x, y, left=left, right=right: (labels[left[x]] != labels[right[y]]) & (ids[left[x]] < ids[right[y]] if right is left else True)
            x, y = tree_join(tree, tree if alone else CountTree(points[right]), p, q, wanted)
            x, y = left[x], right[y]
            if kind not in (NEAREST, EVERY):
                own = forest(labels[x], labels[y], mix(ids[x].view(np.uint64) ^ mix(ids[y].view(np.uint64)) ^ np.uint64(kind)))
                a, b = ids[x[own]], ids[y[own]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), keys[s])), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["key", "a", "b"])
                continue
            if kind == NEAREST and len(x):
                # of the partners of a member in one other class the one with the smallest id
                chosen = np.zeros(len(x), bool)
                for one, other in ((x, y), (y, x)):
                    order = np.lexsort((ids[other], labels[other], one))
                    new = np.concatenate([[True], (one[order][1:] != one[order][:-1]) | (labels[other[order]][1:] != labels[other[order]][:-1])])
                    chosen[order[new]] = True
                x, y = x[chosen], y[chosen]
            first = [k for k, (u, v) in enumerate(zip(x.tolist(), y.tolist(), strict=True)) if min(np.intersect1d(smallest(u), smallest(v), assume_unique=True), default=keys[s]) == keys[s]]
            if first:
                a, b = ids[x[first]], ids[y[first]]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), keys[s])), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["key", "a", "b"])

    return dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "key long, a long, b long")


def _runs_of_rows(cell: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.flatnonzero((cell[1:] != cell[:-1]).any(1)) + 1, [len(cell)]])


def set_classes(rows: DataFrame, n: int, p: int, q: int) -> tuple[DataFrame, DataFrame]:
    """From ``row, text`` (one row per key): ``row, n_shingles, mark`` of every row, and ``v, label`` of the sets that are
    linked with another one; the label is the smallest mark of the class."""
    cells = durable(cell_rows(rows, n, p, q), "cells")
    marks = durable(cells.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("row"), F.col("b").alias("n_shingles"), F.col("c").alias("mark")), "marks")
    met = durable(cells.where(F.col("kind") == PAIR).select("key", "a", "b"), "met")
    release(cells)
    pairs = durable(met.groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    wanted = durable(pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct(), "wanted")
    holders = semi_join(marks, wanted, "mark").groupBy("mark").agg(F.min("row").alias("row"))
    sets = bucketed(sets_of(maybe_join(rows, durable(holders.select("row"), "holders"), "row"), n), "sets", "mark")
    points = bucketed(points_of(sets), "points", "mark")

    def told(some: DataFrame) -> DataFrame:
        """``a, b, linked``; few of the pairs are moved with their sets."""
        bounded = durable(not_ruled_out(some, points, p, q), "bounded")
        linked = verify(bounded.where("possible"), sets, p, q)
        out = durable(linked.unionByName(bounded.where("NOT possible").withColumnRenamed("possible", "linked")), "checked")
        release(bounded)
        return out

    # first each text with the one it met most often, then what is still apart
    first = durable(pairs.groupBy("b").agg(F.max_by("a", F.struct("n", "a")).alias("a")).select("a", "b"), "first")
    checked = told(first)
    links = checked.where("linked").select("a", "b")
    classes = components(links)
    rest = durable(between_classes(pairs.select("a", "b").join(checked.select("a", "b"), ["a", "b"], "left_anti"), classes), "rest")
    again = told(rest)
    if again.where("linked").limit(1).count():
        links = links.unionByName(again.where("linked").select("a", "b"))
        classes = components(links)
    release(pairs, first, rest)

    # members of the cells with a pair that is not in one class yet, and at least one more member
    done = checked.unionByName(again).select("a", "b")
    apart = between_classes(checked.unionByName(again).where("NOT linked").select("a", "b"), classes)
    keys = met.join(apart, ["a", "b"], "left_semi").select("key").distinct()
    members = durable(met.join(keys, "key", "left_semi").select("key", F.explode(F.array("a", "b")).alias("id")).distinct(), "members")
    release(met)
    for turn in range(FORESTS + 2):
        labelled = members.join(classes, F.col("id") == F.col("v"), "left").select("key", "id", F.coalesce("label", "id").alias("label"))
        # of cells with the same members one is enough; a cell of two members has had its pair verified
        shape = labelled.groupBy("key").agg(F.count("*").alias("m"), F.bit_xor(F.xxhash64("id")).alias("x"), F.bit_xor(F.xxhash64("id", F.lit(1))).alias("y"), (F.min("label") != F.max("label")).alias("mixed"))
        mixed = shape.where("m > 2 AND mixed").groupBy("m", "x", "y").agg(F.min("key").alias("key")).select("key")
        searched = durable(labelled.join(mixed, "key", "left_semi"), "searched")
        placed = points.withColumnRenamed("mark", "id").join(searched.hint("merge"), "id")
        if turn < FORESTS:
            left = durable(forest_pairs(placed, p, q, turn), "left")
            # a cell without a pair for the forest has none across classes, which only grow
            fewer = durable(searched.join(left.select("key").distinct(), "key", "left_semi").select("key", "id"), "members")
            release(members)
            members, more = fewer, left.select("a", "b").distinct()
        else:
            more = remaining_pairs(placed, p, q, turn == FORESTS)
        more = durable(more.join(done, ["a", "b"], "left_anti"), "more")
        found = durable(verify(more, sets, p, q), "found")
        release(searched, more)
        # what is nearest may have been checked before; the pass over all pairs comes in any case
        if not found.limit(1).count():
            continue
        done = done.unionByName(found.select("a", "b"))
        links = links.unionByName(found.where("linked").select("a", "b"))
        classes = components(links)
    release(sets, points, members, wanted)
    return marks, classes


def link_classes(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_shingles, component_id`` of every row: the smallest id reachable over links, where two texts link when
    their Jaccard similarity over distinct word n-grams is at least p / q."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = with_row_key(rows, "id", "text")
    marks, classes = set_classes(rows.select(F.col(ROW).alias("row"), "text"), n, p, q)
    of = durable(rows.select("id", F.col(ROW).alias("row")), "ids").join(marks.dropDuplicates(["row"]), "row")
    of = of.join(classes, F.col("mark") == F.col("v"), "left").select("id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("label", "mark")).alias("label"))
    of = durable(of, "of")
    # the smallest id of each class that has more than one
    named = of.where("id IS NOT NULL AND label IS NOT NULL").groupBy("label").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    low = durable(named.select(F.col("label").alias("class"), "low"), "low")
    out = durable(of.join(low, F.col("label") == F.col("class"), "left").select("id", "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("low", "id")).alias("component_id")), "out")
    # an id with several texts joins their classes
    several = durable(out.where("id IS NOT NULL").groupBy("id").agg(F.min("component_id").alias("a"), F.max("component_id").alias("b")).where("a < b"), "several")
    if several.limit(1).count():
        links = out.join(several.select("id", "a"), "id").select("a", F.col("component_id").alias("b")).where("a <> b")
        joined = components(links.distinct())
        out = out.join(joined, F.col("component_id") == F.col("v"), "left").select("id", "n_shingles", F.coalesce("label", "component_id").alias("component_id"))
    return out


def between_classes(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ends lie in different classes."""
    side = lambda c: classes.select(F.col("v").alias(c), F.col("label").alias(f"l{c}"))
    both = pairs.join(side("a"), "a", "left").join(side("b"), "b", "left")
    return both.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b")


def near_copies(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for 3-word shingles and a similarity of 0.9."""
    return link_classes(docs, n=3, p=90, q=100).withColumnRenamed("id", "doc_id")


def keep_one(docs: DataFrame, n: int = 5, p: int = 80, q: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each class: that with the smallest id (rows without an id last, ties by a hash of the row).
    Rows without words are kept; rows that are equal in all columns are one."""
    rows = with_row_key(docs)
    counted = durable(rows.groupBy(ROW).agg(F.count("*").alias("times"), F.first(F.col(id_col).cast("long")).alias("id")), "counted")
    marks, classes = set_classes(rows.select(F.col(ROW).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text")), n, p, q)
    of = marks.dropDuplicates(["row"]).join(classes, F.col("mark") == F.col("v"), "left").where("n_shingles > 0").select(F.col("row").alias(ROW), F.coalesce("label", "mark").alias("label"))
    of = durable(of.join(counted, ROW), "of")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col(ROW))
    best = of.groupBy("label").agg(F.min_by(ROW, order).alias("best"), F.count("*").alias("n")).where("n > 1").select(F.col("label").alias("class"), "best")
    gone = durable(of.join(best, F.col("label") == F.col("class")).where(F.col(ROW) != F.col("best")).select(ROW), "gone")
    kept = anti_join(rows, gone, ROW)
    # of rows that are equal in all columns one stays
    again = durable(counted.where("times > 1").select(ROW), "again")
    repeated = semi_join(kept, again, ROW).dropDuplicates([ROW])
    return anti_join(kept, again, ROW).unionByName(repeated).select(*docs.columns)
