"""Agglomerative clustering of more rows than one matrix of distances holds, in passes.

Average, complete and ward linkage are reducible: clusters that are each other's nearest end up merged whatever else is merged
first. A pass finds the nearest few clusters of every cluster by products of blocks of points, and gives them to the driver, which
merges all pairs that are certainly nearest to each other: what is not in the lists is known to be at least as far as their ends.
When ``LAST`` clusters are left, their distances go to the driver, which merges them to the end. The k - 1 highest merges of all
are undone. Without ties this is the result of merging one pair at a time.

For average and complete linkage the distances of the last ``DENSE`` clusters are kept in a table; average linkage, whose lists soon
hold back, then merges the ``LAST`` clusters with the nearest others up to the least distance of any cluster beside them.

The work is quadratic, as the method is stated; a task's memory is that of two blocks and the lists of its clusters. The driver holds
``PAIRS`` pairs (or ``LEAST`` a cluster) and a few numbers a vector, never the vectors. Copies of a vector are one weighted point.
A pass merges one pair at least; each halved the clusters or so on random vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from . import clustering as C

#: Clusters whose distances the driver holds (128 MB); points of a block.
LAST, BLOCK = 4000, 1024
#: Pairs that a pass gives the driver, and the least of them for each cluster.
PAIRS, LEAST = 4_000_000, 8
#: Clusters whose distances go to a table once (2 GB) instead of being taken from the points in every pass.
DENSE = 16384

_PACKED = "blk string, whole boolean, cluster binary, n binary, x binary"
_CELLS = "a long, b long, v double, w double"
_ROWS = "a long, x binary"


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a block (cluster, id, n, x) as bytes, which are cheap to pair."""
    for batch in batches:
        out = []
        for i in range(batch.num_rows):
            cells = batch.column("rows").slice(i, 1).flatten()
            out.append([c.tobytes() for c in (cells.field("cluster").to_numpy(), cells.field("n").to_numpy().astype(float), cells.field("x").flatten().to_numpy())])
        packed = [pa.array(c, pa.binary()) for c in zip(*out)] if out else [pa.array([], pa.binary())] * 3
        yield pa.RecordBatch.from_arrays([batch.column("blk"), batch.column("whole"), *packed], names=["blk", "whole", "cluster", "n", "x"])


def _tables(batch: pa.RecordBatch, side: str) -> Iterator[tuple]:
    """Name, whether its clusters are all complete, clusters, weights and vectors of the blocks in a batch."""
    column = lambda c: batch.column(f"{side}_{c}")
    for i in range(batch.num_rows):
        cluster, n, x = (np.frombuffer(column(c)[i].as_buffer(), t) for c, t in (("cluster", np.int64), ("n", float), ("x", float)))
        yield column("blk")[i].as_py(), column("whole")[i].as_py(), cluster, n, x.reshape(len(n), -1)


class _Nearest:
    """The ``most`` nearest clusters of each cluster ``a`` among those seen."""

    def __init__(self, a: np.ndarray, most: int):
        self.a, self.most, self.limit = a, most, np.full(len(a), np.inf)
        self.row, self.b, self.d = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.new: list = []

    def add(self, b: np.ndarray, d: np.ndarray) -> None:
        if np.isinf(self.limit).all() and d.shape[1] > self.most:
            j = np.argpartition(d, self.most - 1, axis=1)[:, : self.most].ravel()
            i = np.repeat(np.arange(len(d)), self.most)
        else:
            i, j = np.divmod(np.flatnonzero(d < self.limit[:, None]), d.shape[1])
        self.new.append((i, b[j], d[i, j]))
        if sum(len(x[0]) for x in self.new) * 2 >= len(self.row):
            self.settle()

    def settle(self) -> None:
        row, b, d = (np.concatenate((was, *(x[c] for x in self.new))) for c, was in enumerate((self.row, self.b, self.d)))
        there = np.isfinite(d)
        row, b, d, self.new = row[there], b[there], d[there], []
        order = np.lexsort((b, d, row))
        row, b, d = row[order], b[order], d[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        self.limit[row[place == self.most - 1]] = d[place == self.most - 1]
        self.row, self.b, self.d = (x[place < self.most] for x in (row, b, d))


def _between(linkage: str):
    """Of two blocks: clusters a and b, (a, b) values v and weights w or None for ones; ``_cells`` says what they mean."""

    def between(left: tuple, right: tuple) -> tuple:
        (_, _, ca, na, x), (_, _, cb, nb, y) = left, right
        ends = lambda p, *c: np.column_stack((p, *c))
        d = ends(-2 * x, (x * x).sum(1), np.ones(len(x))) @ ends(y, np.ones(len(y)), (y * y).sum(1)).T
        np.maximum(d, 0, out=d)
        if linkage == "ward":
            d *= 2 * na[:, None]
            d *= nb[None] / (na[:, None] + nb[None])
            return ca, cb, d, None
        np.sqrt(d, out=d)
        (a, i), (b, j) = np.unique(ca, return_index=True), np.unique(cb, return_index=True)
        if linkage == "complete":
            d = d if len(a) == len(ca) else np.maximum.reduceat(d, i, axis=0)
            d = d if len(b) == len(cb) else np.maximum.reduceat(d, j, axis=1)
            return a, b, d, None
        if len(a) < len(ca) or na.max() > 1:
            d *= na[:, None]
            d = np.add.reduceat(d, i, axis=0)
        if len(b) < len(cb) or nb.max() > 1:
            d *= nb[None]
            d = np.add.reduceat(d, j, axis=1)
        return a, b, d, np.add.reduceat(na, i)[:, None] * np.add.reduceat(nb, j)[None]

    return between


def _cells(linkage: str, most: int | None):
    """Pairs of blocks to (a, b, v, w): the distance of clusters is the sum of v by that of w, or the greatest v for complete linkage.

    Of complete clusters only the ``most`` nearest b of each a go on; without ``most`` every pair a < b does.
    """
    between = _between(linkage)

    def rows(a, b, v, w) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(v), pa.array(w)], names=["a", "b", "v", "w"])

    def run(batches: Iterator[pa.RecordBatch]):
        lists: dict = {}
        for batch in batches:
            for left, right in zip(_tables(batch, "l"), _tables(batch, "r")):
                a, b, v, w = between(left, right)
                if most is None or not (left[1] and right[1]):
                    i, j = np.nonzero(a[:, None] < b[None] if most is None else a[:, None] != b[None])
                    yield rows(a[i], b[j], v[i, j], np.ones(len(i)) if w is None else w[i, j])
                    continue
                if w is not None:
                    v /= w
                _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
                v[i, j] = np.inf
                if left[0] not in lists:
                    lists[left[0]] = _Nearest(a, most)
                lists[left[0]].add(b, v)
        for near in lists.values():
            near.settle()
            yield rows(near.a[near.row], near.b, near.d, np.ones(len(near.row)))

    return run


def _blocks(points: DataFrame, n: int, scratch: Scratch) -> tuple[DataFrame, int]:
    """(blk, whole, cluster, n, x) and how many there are: ``n`` points (id, x, n, cluster, size) in blocks of complete clusters, or pieces of a large one, packed."""
    pieces = F.ceil(F.col("size") / BLOCK)
    own = F.concat_ws(":", "cluster", F.pmod(F.xxhash64("id"), pieces))
    shared = F.pmod(F.xxhash64("cluster"), F.lit(max(1, math.ceil(n / BLOCK)))).cast("string")
    large = F.col("size") > BLOCK // 4
    dealt = points.select(F.when(large, own).otherwise(shared).alias("blk"), (pieces == 1).alias("whole"), F.struct("cluster", "id", "n", "x").alias("p"))
    points.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 25))
    rows = dealt.groupBy("blk").agg(F.min("whole").alias("whole"), F.sort_array(F.collect_list("p")).alias("rows"))
    blocks, seen = scratch.cut_counting(rows.mapInArrow(_pack, _PACKED), n=F.count(F.lit(1)))
    return blocks, seen["n"]


def _paired(blocks: tuple[DataFrame, int]) -> tuple[DataFrame, int]:
    """All pairs of blocks, and among how many tasks those of one left block are."""
    packed, n = blocks
    spark = packed.sparkSession
    named = lambda side: packed.select(*[F.col(c).alias(f"{side}_{c}") for c in packed.columns])
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(1 << 25))  # a row has two blocks
    # a task holds some 128 blocks of the right side
    parts = -(-max(1, n) // 128)
    spread = named("l").repartition(max(1, min(4 * spark.sparkContext.defaultParallelism, n)))
    packs = named("r").repartition(parts)
    return spread.hint("shuffle_replicate_nl").crossJoin(packs), parts


def _compared(blocks: tuple[DataFrame, int], linkage: str, most: int | None, pieces: bool) -> pa.Table:
    """(a, b, d) of clusters: the ``most`` nearest b of each a, or every a < b; ``pieces`` says that a cluster is in several blocks."""
    pairs, parts = _paired(blocks)
    found = pairs.mapInArrow(_cells(linkage, most), _CELLS)
    if pieces:
        found = found.groupBy("a", "b").agg((F.max("v") if linkage == "complete" else F.sum("v") / F.sum("w")).alias("d"))
    else:
        found = found.select("a", "b", (F.col("v") / F.col("w")).alias("d"))
    if most is not None and (pieces or parts > 1):  # else a task has seen all b of its a
        place = F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))
        found = found.select("*", place.alias("place")).where(F.col("place") <= most).drop("place")
    return found.toArrow()


def _as_rows(held: dict) -> Iterator[pa.RecordBatch]:
    """(a, x) of {a: array}, some 8 MB a batch."""
    every = sorted(held)
    step = max(1, (1 << 20) // len(held[every[0]])) if every else 1
    for at in range(0, len(every), step):
        some = every[at : at + step]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([held[a].tobytes() for a in some], pa.binary())], names=["a", "x"])


def _row_cells(linkage: str, names: np.ndarray):
    """Pairs of blocks to (a, x): the values v of cluster a, by place in ``names``, and all clusters, as far as the blocks have them."""
    between, add = _between(linkage), np.maximum if linkage == "complete" else np.add

    def run(batches: Iterator[pa.RecordBatch]):
        held: dict = {}
        for batch in batches:
            for left, right in zip(_tables(batch, "l"), _tables(batch, "r")):
                a, b, v, _ = between(left, right)
                at = np.searchsorted(names, b)
                for i, row in zip(np.searchsorted(names, a).tolist(), v):
                    mine = held.setdefault(i, np.zeros(len(names)))
                    mine[at] = add(mine[at], row)
        yield from _as_rows(held)

    return run


def _summed(rows: DataFrame, linkage: str, to: np.ndarray | None, parts: int) -> DataFrame:
    """Rows (a, x) of clusters that are one after ``to`` (place by former place) put together, in their columns as well."""
    add = np.maximum if linkage == "complete" else np.add
    order = None if to is None else np.argsort(to, kind="stable")
    starts = None if to is None else np.searchsorted(to[order], np.arange(to.max() + 1))

    def narrow(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            a = to[batch.column("a").to_numpy()]
            x = [add.reduceat(np.frombuffer(v.as_buffer(), float)[order], starts).tobytes() for v in batch.column("x")]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(x, pa.binary())], names=["a", "x"])

    def together(batches: Iterator[pa.RecordBatch]):
        held: dict = {}
        for batch in batches:
            for a, v in zip(batch.column("a").to_pylist(), batch.column("x")):
                x = np.frombuffer(v.as_buffer(), float)
                held[a] = add(held[a], x) if a in held else x.copy()
        yield from _as_rows(held)

    narrowed = rows if to is None else rows.mapInArrow(narrow, _ROWS)
    return narrowed.repartition(parts, "a").mapInArrow(together, _ROWS)


def _lists(linkage: str, size: np.ndarray, most: int):
    """Rows (a, x) to (a, b, d) of the ``most`` nearest b of each a."""

    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a, v in zip(batch.column("a").to_pylist(), batch.column("x")):
                d = _distances(np.frombuffer(v.as_buffer(), float), a, size, linkage)
                b = np.argpartition(d, most - 1)[:most]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(most, a)), pa.array(b), pa.array(d[b])], names=["a", "b", "d"])

    return run


def _lowest(rows: DataFrame, linkage: str, size: np.ndarray) -> list[tuple]:
    """Merges (parent, child, distance), one pair after the other, as far as the ``LAST`` clusters with the nearest others tell; all others' nearest are farther."""

    def near(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            a = batch.column("a")
            low = [_distances(np.frombuffer(v.as_buffer(), float), i, size, linkage).min() for i, v in zip(a.to_pylist(), batch.column("x"))]
            yield pa.RecordBatch.from_arrays([a, pa.array(low, pa.float64())], names=["a", "d"])

    found = rows.mapInArrow(near, "a long, d double").toArrow().sort_by([("d", "ascending"), ("a", "ascending")])
    some, limit = np.sort(found.column("a").to_numpy()[:LAST]), found.column("d").to_numpy()[LAST]

    def among(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for a, v in zip(batch.column("a").to_pylist(), batch.column("x")):
                if some[min(np.searchsorted(some, a), len(some) - 1)] == a:
                    d = _distances(np.frombuffer(v.as_buffer(), float), a, size, linkage)[some]
                    yield pa.RecordBatch.from_arrays([pa.array([a]), pa.array([d.tobytes()], pa.binary())], names=["a", "x"])

    matrix, out = np.empty((len(some), len(some))), []
    for batch in rows.mapInArrow(among, _ROWS).toArrow().to_batches():
        for a, v in zip(batch.column("a").to_pylist(), batch.column("x")):
            matrix[np.searchsorted(some, a)] = np.frombuffer(v.as_buffer(), float)
    np.minimum(matrix, matrix.T.copy(), out=matrix)  # the two sums of a pair may be rounded differently
    for i, j, h in C.merged(matrix, size[some], 1, linkage):
        if h > limit and out:
            break
        out.append((some[[i]], some[[j]], np.array([h])))
    return out


def _distances(x: np.ndarray, a: int, size: np.ndarray, linkage: str) -> np.ndarray:
    """Of cluster a to all, infinite to itself, from its row."""
    d = x.copy() if linkage == "complete" else x / (size[a] * size)
    d[a] = np.inf
    return d


def settled(a: np.ndarray, b: np.ndarray, d: np.ndarray, bound: np.ndarray, size: np.ndarray, linkage: str) -> list[tuple]:
    """Rounds (parents, children, distances) of the merges that hold whatever the other pairs' distances are.

    Clusters a < b are d apart; any other pair is at least the greater ``bound`` of its two apart. Merged clusters get their distances
    by Lance-Williams, from bounds where one isn't known: such a distance is a lower bound and no pair for merging.
    """
    m, exact, out = len(size), np.ones(len(a), bool), []
    size, bound = size.astype(float), bound.copy()
    order = np.lexsort((b, a, d))
    a, b, d = a[order], b[order], d[order]
    while len(a):
        places = np.arange(len(a))
        first = np.full((2, m), len(a))
        first[0, a[::-1]], first[1, b[::-1]] = places[::-1], places[::-1]
        p, first = first[0], first.min(0)
        p = p[p < len(a)]
        p = p[(first[a[p]] == p) & (first[b[p]] == p) & exact[p] & (d[p] <= np.minimum(bound[a[p]], bound[b[p]]))]
        if not len(p):
            break
        i, j, h = a[p], b[p], d[p]
        out.append((i, j, h))
        child, height, to, hit = np.full(m, -1), np.zeros(m), np.arange(m), np.zeros(m, bool)
        child[i], height[i], to[j], hit[i], hit[j] = j, h, i, True, True
        was, least = size.copy(), bound.copy()
        size[i] += size[j]
        bound[i] = np.maximum(least[i], least[j]) if linkage == "complete" else (was[i] * least[i] + was[j] * least[j]) / size[i]
        changed = hit[a] | hit[b]
        olds, news = np.stack((a[changed], b[changed])), to[np.stack((a[changed], b[changed]))]
        swap = news[0] > news[1]
        olds, news = np.where(swap, olds[::-1], olds), np.where(swap, news[::-1], news)
        two = news[0] != news[1]
        olds, news, known, sure = olds[:, two], news[:, two], d[changed][two], exact[changed][two]
        pairs, group = np.unique(news[0] * m + news[1], return_inverse=True)
        e, f = pairs // m, pairs % m
        # up to four pairs of old clusters make a new one
        left, right = np.stack((e, e, child[e], child[e]), 1), np.stack((f, child[f], f, child[f]), 1)
        real = (left >= 0) & (right >= 0)
        v, firm, slot = np.maximum(least[left], least[right]), ~real, 2 * (olds[0] != news[0]) + (olds[1] != news[1])
        v[group, slot], firm[group, slot] = known, sure
        v[~real] = 0
        if linkage == "complete":
            v = v.max(1)
        elif linkage == "average":
            v = (v * was[left] * was[right]).sum(1) / (size[e] * size[f])
        else:
            v = ((v * (was[left] + was[right])).sum(1) - size[f] * height[e] - size[e] * height[f]) / (size[e] + size[f])
        firm = firm.all(1)
        use = np.flatnonzero(firm | (v < np.maximum(bound[e], bound[f])))  # else the bounds say as much
        use = use[np.argsort(v[use], kind="stable")]
        a, b, d, exact = a[~changed], b[~changed], d[~changed], exact[~changed]
        put = np.searchsorted(d, v[use], side="right")
        a, b, d, exact = (np.insert(x, put, y[use]) for x, y in ((a, e), (b, f), (d, v), (exact, firm)))
    return out


def _from_lists(a: np.ndarray, b: np.ndarray, d: np.ndarray, size: np.ndarray, most: int, linkage: str) -> list[tuple]:
    """``settled`` of the ``most`` nearest b of each a."""
    bound = np.full(len(size), np.inf)
    if most < len(size) - 1:
        bound[:] = 0
        np.maximum.at(bound, a, d)
    low = np.lexsort((d, np.maximum(a, b), np.minimum(a, b)))
    a, b, d = np.minimum(a, b)[low], np.maximum(a, b)[low], d[low]
    once = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))
    return settled(a[once], b[once], d[once], bound, size, linkage)


def _labels(merges: list[tuple], m: int, k: int) -> np.ndarray:
    """The cluster, named by its least member, of each of m points after all merges but the k - 1 highest."""
    top, heights = np.zeros(m), []
    for i, j, h in merges:  # rounded, a merge may seem lower than one below it
        top[i] = np.maximum(h, np.maximum(top[i], top[j]))
        heights.append(top[i])
    parent, child = (np.concatenate([x[c] for x in merges]) for c in (0, 1))
    kept = np.argsort(np.concatenate(heights), kind="stable")[: m - k]
    root = np.arange(m)
    root[child[kept]] = parent[kept]
    while not np.array_equal(root, root[root]):
        root = root[root]
    return root


def agglomerative_in_rounds(points: DataFrame, k: int, linkage: str = "ward") -> DataFrame:
    """(id, cluster), as ``clustering.agglomerative``, of any number of rows."""
    if linkage not in C.LINKAGES:
        raise ValueError(f"linkage is one of {C.LINKAGES}")
    spark, scratch = points.sparkSession, Scratch(points.sparkSession, "agglomerative")
    given = scratch.cut(points.select("id", "x"))
    distinct, seen = scratch.cut_counting(given.groupBy("x").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")).select("id", "x", "n"), m=F.count(F.lit(1)))
    copies = given.join(distinct.select("x", F.col("id").alias("cluster")), "x").select("id", "cluster")
    m = seen["m"]
    if m <= k:  # copies stay apart, those of the highest numbers
        alone = copies.where("id <> cluster").orderBy(F.desc("cluster"), F.desc("id")).limit(k - m).select("id", F.col("id").alias("own"))
        every = scratch.cut(copies.join(alone, "id", "left").select("id", F.coalesce("own", "cluster").alias("root")))
        return _numbered(every, sorted(r[0] for r in every.select("root").distinct().collect()))
    table = distinct.select("id", "n").toArrow().sort_by("id")
    names, size = table.column("id").to_numpy(), table.column("n").to_numpy().astype(float)
    alive, root, merges, now, rows = np.arange(m), np.arange(m), [], distinct, None
    parts = 4 * spark.sparkContext.defaultParallelism
    while True:
        few, lowest = len(alive) <= LAST, linkage == "average" and len(alive) <= 5 * LAST // 2  # unknown distances spread in its lists
        most = None if few else min(max(LEAST, PAIRS // len(alive)), len(alive) - 1)
        held = np.ones(m, np.int64) if linkage == "ward" else np.bincount(root, minlength=m)
        pieces = bool(held.max() > BLOCK)
        if rows is not None:
            pass
        elif linkage == "ward":  # centroids stand for their points
            dealt = now.select("*", F.col("id").alias("cluster"), F.lit(1).alias("size"))
        else:
            dealt = now.join(spark.createDataFrame(pa.table({"id": names, "cluster": names[root], "size": held[root]})), "id")
        if rows is None:
            blocks = _blocks(dealt, len(alive) if linkage == "ward" else m, scratch)
            if linkage != "ward" and len(alive) <= DENSE:
                pairs, packs = _paired(blocks)
                cells = pairs.mapInArrow(_row_cells(linkage, names[alive]), _ROWS)
                rows = scratch.cut(_summed(cells, linkage, None, parts) if pieces or packs > 1 else cells)
            else:
                found = _compared(blocks, linkage, most, pieces)
            scratch.drop(blocks[0])
        if rows is not None and few:
            matrix = np.empty((len(alive), len(alive)))
            for batch in rows.toArrow().to_batches():
                for i, v in zip(batch.column("a").to_pylist(), batch.column("x")):
                    matrix[i] = _distances(np.frombuffer(v.as_buffer(), float), i, size[alive], linkage)
            matrix = np.minimum(matrix, matrix.T)  # the two sums of a pair may be rounded differently
        elif rows is not None and lowest:
            done = _lowest(rows, linkage, size[alive])
        elif rows is not None:
            found = rows.mapInArrow(_lists(linkage, size[alive], most), "a long, b long, d double").toArrow()
            a, b, d = (found.column(c).to_numpy() for c in ("a", "b", "d"))
        else:
            a, b = (np.searchsorted(names[alive], found.column(c).to_numpy()) for c in ("a", "b"))
            d = found.column("d").to_numpy()
            if few:
                matrix = np.full((len(alive), len(alive)), np.inf)
                matrix[a, b] = matrix[b, a] = d
        found = None
        if few:
            merges += [(alive[[i]], alive[[j]], np.array([h])) for i, j, h in C.merged(matrix, size[alive], 1, linkage)]
            break
        if rows is None or not lowest:
            done = _from_lists(a, b, d, size[alive], most, linkage)
        done = [(alive[i], alive[j], h) for i, j, h in done]
        to = np.arange(m)
        for i, j, _ in done:
            size[i] += size[j]
            to[j] = i
        while not np.array_equal(to, to[to]):
            to = to[to]
        merges += done
        before, alive, root = alive, alive[to[alive] == alive], to[root]
        if rows is not None:
            merged = scratch.cut(_summed(rows, linkage, np.searchsorted(alive, to[before]), parts))
            scratch.drop(rows)
            rows = merged
        if linkage == "ward":
            mean = F.aggregate("z", F.transform(F.col("z")[0]["x"], lambda _: F.lit(0.0)), lambda s, p: F.zip_with(s, p["x"], lambda u, v: u + v * p["n"]))
            moved = now.join(spark.createDataFrame(pa.table({"id": names, "cluster": names[to]})), "id")
            sums = moved.groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("id", "n", "x"))).alias("z"), F.sum("n").alias("n"))
            centroids = scratch.cut(sums.select(F.col("cluster").alias("id"), F.transform(mean, lambda v: v / F.col("n")).alias("x"), "n"))
            if now is not distinct:
                scratch.drop(now)
            now = centroids
    root = _labels(merges, m, k)
    rooted = spark.createDataFrame(pa.table({"cluster": names, "root": names[root]}))
    return _numbered(scratch.cut(copies.join(rooted, "cluster").select("id", "root")), names[np.unique(root)].tolist())


def _numbered(rooted: DataFrame, roots: list) -> DataFrame:
    """Clusters by number, in order of their least identifiers."""
    numbers = rooted.sparkSession.createDataFrame([(r, c) for c, r in enumerate(roots)], "root long, cluster int")
    return rooted.join(F.broadcast(numbers), "root").select("id", "cluster")
