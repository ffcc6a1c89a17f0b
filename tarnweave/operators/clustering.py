"""Clustering: Lloyd's k-means in DataFrames, MLlib k-means with restarts, agglomerative."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch, dealt

#: Agglomerative clustering holds all distances; more rows are refused.
MAX_AGGLOMERATIVE = 5000
LINKAGES = ("average", "complete", "ward")
#: Rounds of an oversampled start, and candidates a round for each cluster.
ROUNDS, OVERSAMPLING = 3, 2
#: Numbers that may stand in a plan as a constant: centroids of all runs together.
MAX_CONSTANT = 1 << 21
#: Fits of MLlib that run at a time.
SIDE_BY_SIDE = 10
#: Rows whose distances are taken at a time.
AT_ONCE = 1024


def _literal(centroids: Sequence[Sequence[float]]) -> Column:
    if sum(map(len, centroids)) > MAX_CONSTANT:
        raise ValueError(f"centroids of more than {MAX_CONSTANT} numbers don't go into a plan; sparse_kmeans keeps them in tables")
    text = json.dumps([[float(x) for x in c] for c in centroids])
    return F.from_json(F.lit(text), "array<array<double>>")


def _square(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def _dealt_evenly(points: DataFrame) -> DataFrame:
    """``points`` over all cores, however few files or row groups they come from."""
    return points.select("id", "x").repartition(points.sparkSession.sparkContext.defaultParallelism, "id").persist(StorageLevel.MEMORY_AND_DISK)


def _with_distances(points: DataFrame, centroids: Sequence[Sequence[Sequence[float]]], shape: Callable, schema: str) -> DataFrame:
    """``shape`` of a task's parts: the id and x columns, the vectors as a matrix and, for each set of centroids, the matrix of squared distances.

    Distances are taken from differences, so that equal points have exactly 0; null vectors take no part.
    """
    shared = points.sparkSession.sparkContext.broadcast([np.array(c, float) for c in centroids])

    def run(batches: Iterator[pa.RecordBatch]):
        sets = shared.value
        every = np.concatenate([c for c in sets if len(c)])
        ends = np.cumsum([len(c) for c in sets])[:-1]

        def parts():
            for b in batches:
                b = b.filter(b.column(1).is_valid())
                for at in range(0, b.num_rows, AT_ONCE):
                    some = b.slice(at, AT_ONCE)
                    flat = some.column(1).flatten().to_numpy(zero_copy_only=False)
                    if len(flat) != some.num_rows * every.shape[1]:
                        raise ValueError("vectors of another length than the centroids")
                    x = flat.reshape(some.num_rows, -1)
                    d = np.empty((len(every), len(x)))
                    for j, c in enumerate(every):
                        away = x - c
                        d[j] = np.einsum("ij,ij->i", away, away)
                    yield some.column(0), some.column(1), x, np.split(d.T, ends, axis=1)

        yield from shape(parts())

    return points.select("id", "x").mapInArrow(run, schema)


def _types(points: DataFrame) -> str:
    return ", ".join(f"{c} {points.schema[c].dataType.simpleString()}" for c in ("id", "x"))


def assign_all(points: DataFrame, starts: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """(id, x, run, cluster, sq_dist): for each set of centroids the nearest one, the lower number on a tie."""

    def shape(parts):
        for ids, vectors, x, squares in parts:
            best = np.stack([d.argmin(1) for d in squares], 1)
            least = np.stack([d.min(1) for d in squares], 1)
            take = pa.array(np.repeat(np.arange(len(x)), len(squares)))
            runs = np.tile(np.arange(len(squares), dtype=np.int32), len(x))
            yield pa.RecordBatch.from_arrays([ids.take(take), vectors.take(take), pa.array(runs), pa.array(best.ravel().astype(np.int32)), pa.array(least.ravel())], names=["id", "x", "run", "cluster", "sq_dist"])

    return _with_distances(points, starts, shape, f"{_types(points)}, run int, cluster int, sq_dist double")


def costs_all(points: DataFrame, centroids: Sequence[Sequence[Sequence[float]]]) -> DataFrame:
    """(run, sse) of each set of centroids; a task adds up its own rows first."""

    def shape(parts):
        total = np.zeros(len(centroids))
        for *_, squares in parts:
            total += [d.min(1).sum() for d in squares]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["run", "sse"])

    return _with_distances(points, centroids, shape, "run int, sse double").groupBy("run").agg(F.sum("sse").alias("sse"))


def assign(points: DataFrame, centroids: Sequence[Sequence[float]]) -> DataFrame:
    """(id, x, cluster, sq_dist): the nearest centroid, the lower number on a tie."""
    return assign_all(points, [centroids]).drop("run")


def update_all(assigned: DataFrame, previous: Sequence[Sequence[Sequence[float]]]) -> list[list[list[float]]]:
    """Means of the clusters of every run; an empty cluster keeps its centroid. The driver gets the centroids alone, of any width."""
    from pyspark.ml.functions import array_to_vector

    return _means(assigned.select("run", "cluster", array_to_vector("x").alias("x"), F.lit(1.0).alias("n")), previous)


def _means(rows: DataFrame, previous: Sequence[Sequence[Sequence[float]]]) -> list[list[list[float]]]:
    """Of (run, cluster, x, n), where n points have the mean x."""
    from pyspark.ml.stat import Summarizer

    means = rows.groupBy("run", "cluster").agg(Summarizer.mean(F.col("x"), F.col("n")).alias("m")).collect()
    out = [[list(c) for c in run] for run in previous]
    for run, cluster, mean in means:
        out[run][cluster] = mean.toArray().tolist()
    return out


def step_all(points: DataFrame, centroids: Sequence[Sequence[Sequence[float]]]) -> list[list[list[float]]]:
    """Centroids of all runs after a step: a task sends one mean a cluster, whatever the number of its points."""
    from pyspark.ml.functions import array_to_vector

    def shape(parts):
        sums, sizes = None, [np.zeros(len(c), np.int64) for c in centroids]
        for _, _, x, squares in parts:
            sums = sums or [np.zeros((len(c), x.shape[1])) for c in centroids]
            for s, n, d in zip(sums, sizes, squares):
                best = d.argmin(1)
                n += np.bincount(best, minlength=len(n))
                for j in np.unique(best):
                    s[j] += x[best == j].sum(0)
        rows = [(r, j, sums[r][j] / n, float(n)) for r, size in enumerate(sizes) for j, n in enumerate(size) if n]
        if rows:
            run, cluster, mean, n = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(cluster, pa.int32()), pa.array(mean, pa.list_(pa.float64())), pa.array(n)], names=["run", "cluster", "x", "n"])

    parts = _with_distances(points, centroids, shape, "run int, cluster int, x array<double>, n double")
    return _means(parts.select("run", "cluster", array_to_vector("x").alias("x"), "n"), centroids)


def as_points(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("x"))


def lloyd_all(points: DataFrame, starts: Sequence[Sequence[Sequence[float]]], steps: int = 3) -> tuple[DataFrame, list[list[list[float]]]]:
    """Steps of several runs together: each reads the points once for all of them, from the cache after the first."""
    centroids = [[list(c) for c in run] for run in starts]
    mine = steps > 1 and not points.is_cached
    kept = _dealt_evenly(points) if mine else points
    try:
        for _ in range(steps):
            centroids = step_all(kept, centroids)
        return assign_all(points, centroids), centroids
    finally:
        if mine:
            kept.unpersist()


def first_points(points: DataFrame, k: int) -> list[list[float]]:
    """The points of the k least ids."""
    return [list(r[0]) for r in points.orderBy("id").limit(k).select("x").collect()]


def lloyd(points: DataFrame, k: int, steps: int = 3, initial: Sequence[Sequence[float]] | None = None) -> tuple[DataFrame, list[list[float]]]:
    """A fixed number of steps from given centroids, or from the k least ids; the assignment to the last ones, and they."""
    assigned, centroids = lloyd_all(points, [initial if initial is not None else first_points(points, k)], steps)
    return assigned.drop("run"), centroids[0]


@dataclass
class Bounded:
    assigned: DataFrame  # id, x, cluster, sq_dist
    centroids: list[list[float]]
    computed: list[int]  # point-to-centroid distances at each assignment, of rows * k


def lloyd_bounded(points: DataFrame, k: int, steps: int = 3, initial: Sequence[Sequence[float]] | None = None, scratch: Scratch | None = None) -> Bounded:
    """``lloyd`` with the same assignments, computing only the distances that the triangle inequality leaves open.

    Each point carries an upper bound on the distance to its own centroid and a lower one on that to any other. When centroids
    move, the bounds give way by as much; a point whose upper bound stays below the lower one, or below half the way from its
    centroid to the nearest other, keeps its cluster without a distance, or after one to tighten the upper bound. The state beside
    the points is one row of four numbers each; how many distances were computed is counted by its write.
    """
    scratch = scratch or Scratch(points.sparkSession, "bounded")
    kept = dealt(points.select("id", "x"), "id")
    now = np.array(initial if initial is not None else first_points(kept, k), float)
    name = lambda d: (F.array_position(d, F.array_min(d)) - 1).cast("int")
    let = lambda value, body: F.transform(F.array(value), body)[0]  # noqa: E731  evaluates it once

    def full(centroids: np.ndarray, used: int) -> Column:
        distances = F.transform(_literal(centroids.tolist()), lambda c: F.sqrt(_square(F.col("x"), c)))
        second = lambda d: F.get(F.array_sort(d), F.lit(1)) if len(centroids) > 1 else F.lit(float("inf"))
        return let(distances, lambda d: F.struct(name(d).alias("cluster"), F.array_min(d).alias("upper"), second(d).alias("lower"), F.lit(used).alias("used")))

    def write(rows: DataFrame, state: Column) -> DataFrame:
        out, seen = scratch.cut_counting(rows.select("id", state.alias("s")).select("id", "s.*"), ["id", "cluster", "upper", "lower"], used=F.coalesce(F.sum("used"), F.lit(0)))
        computed.append(seen["used"])
        return out

    computed: list[int] = []
    if not len(now):
        return Bounded(points.select("id", "x", F.lit(None).cast("int").alias("cluster"), F.lit(None).cast("double").alias("sq_dist")), [], [])
    state = write(kept, full(now, len(now)))
    for _ in range(steps):
        both = kept.join(state, "id")
        after = np.array(update_all(both.withColumn("run", F.lit(0)), [now.tolist()])[0])
        moved = np.sqrt(((after - now) ** 2).sum(1))
        between = np.sqrt(((after[:, None] - after[None]) ** 2).sum(2))
        np.fill_diagonal(between, np.inf)
        numbers = lambda a: F.array(*[F.lit(float(v)) for v in a])
        own = lambda a: F.element_at(numbers(a), F.col("cluster") + 1)
        others = [np.delete(moved, j).max(initial=0.0) for j in range(len(moved))]
        room = 1e-9  # bounds are sums of rounded numbers: what is nearly a tie is computed
        half = np.where(np.isfinite(between.min(1)), between.min(1) / 2, 1e300)
        both = both.withColumn("upper", F.col("upper") + own(moved) + room).withColumn("lower", F.greatest(F.col("lower") - own(others) - room, own(half) - room))
        tight = F.sqrt(_square(F.col("x"), F.element_at(_literal(after.tolist()), F.col("cluster") + 1)))
        keep = lambda upper, used: F.struct("cluster", upper.alias("upper"), F.col("lower").alias("lower"), F.lit(used).alias("used"))
        looked = let(tight, lambda d: F.when(d + room < F.col("lower"), keep(d, 1)).otherwise(full(after, 1 + len(after))))
        old, state = state, write(both, F.when(F.col("upper") < F.col("lower"), keep(F.col("upper"), 0)).otherwise(looked))
        scratch.drop(old)
        now = after
    last = F.element_at(_literal(now.tolist()), F.col("cluster") + 1)
    assigned = points.select("id", "x").join(state.select("id", "cluster"), "id").select("id", "x", "cluster", _square(F.col("x"), last).alias("sq_dist"))
    kept.unpersist()
    return Bounded(assigned, now.tolist(), computed)


def centroid_rows(assigned: DataFrame) -> DataFrame:
    """(cluster, dim, value) of the means of an assignment."""
    cells = assigned.select("cluster", F.posexplode("x").alias("dim", "v"))
    return cells.groupBy("cluster", "dim").agg(F.avg("v").alias("value"))


def sse(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("sq_dist").alias("sse"))


def sse_by_k(points: DataFrame, ks: Sequence[int] = tuple(range(3, 16)), steps: int = 3) -> DataFrame:
    """(k, sse): the elbow curve, all k in one sweep."""
    first = first_points(points, max(ks))
    centroids = lloyd_all(points, [first[:k] for k in ks], steps)[1]
    return costs_all(points, centroids).select(F.element_at(F.array(*[F.lit(k) for k in ks]), F.col("run") + 1).alias("k"), "sse")


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from the first 48 bits of an MD5 of the parts."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def random_start(points: DataFrame, k: int, seed: int = 0) -> list[list[float]]:
    """k points drawn without repetition: those of the least hashes of seed and id."""
    u = _uniform(F.lit(str(seed)), F.col("id").cast("string"))
    return [list(r[0]) for r in points.select("x", "id", u.alias("u")).orderBy("u", "id").limit(k).select("x").collect()]


def plus_plus_start(points: DataFrame, k: int, seed: int = 0) -> list[list[float]]:
    """k-means++: each next centroid is a point drawn with a chance proportional to its squared distance to the nearest one before.

    The draw is a race of exponential clocks, so a pass is one aggregate with a single row as result.
    Fewer distinct points than k give fewer centroids.
    """
    out: list[list[float]] = []
    for j in range(k):
        far = F.array_min(F.transform(_literal(out), lambda c: _square(F.col("x"), c))) if out else F.lit(1.0)
        clock = -F.log(_uniform(F.lit(str(seed)), F.lit(str(j)), F.col("id").cast("string"))) / F.col("far")
        drawn = points.withColumn("far", far).where("far > 0").agg(F.min_by("x", F.struct(clock.alias("t"), "id"))).first()[0]
        if drawn is None:
            break
        out.append(list(drawn))
    return out


def uniform_here(*parts) -> float:
    """``_uniform`` of the parts on the driver."""
    return (int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16) + 0.5) / float(1 << 48)


def weighted_draws(ids: Sequence, weights: Sequence[float], squares: np.ndarray, k: int, seed: int) -> list[int]:
    """Places of up to ``k`` candidates drawn by weighted k-means++ from their squared distances: each next one by weight times distance to the nearest before."""
    far, out = np.ones(len(ids)), []
    for j in range(k):
        clocks = [(-math.log(uniform_here(seed, f"w{j}", i)) / (w * f), i, at) for at, (i, w, f) in enumerate(zip(ids, weights, far)) if w * f > 0]
        if not clocks:
            break
        out.append(min(clocks)[2])
        far = squares[out[-1]].copy() if j == 0 else np.minimum(far, squares[out[-1]])
    return out


def oversampled_starts(points: DataFrame, k: int, seeds: Sequence[int], rounds: int = ROUNDS, factor: int = OVERSAMPLING) -> list[list[list[float]]]:
    """Starts of all seeds from ``rounds`` + 2 passes together: each round draws ``factor`` * k points a seed by their squared
    distance to the nearest before (exponential clocks, so exactly that many), one aggregate weighs the candidates by the points nearest
    to them, and weighted k-means++ picks k of these on the driver, which only ever holds the candidates."""
    held: list[dict] = [{} for _ in seeds]
    seed = F.element_at(F.array(*[F.lit(str(s)) for s in seeds]), F.col("run") + 1)

    def farness(parts):
        for ids, _, _, squares in parts:
            far = pa.array(list(np.stack([d.min(1) for d in squares], 1)), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([ids, far], names=["id", "far"])

    for t in range(rounds + 1):
        if t:
            near = _with_distances(points, [list(h.values()) for h in held], farness, f"id {points.schema['id'].dataType.simpleString()}, far array<double>")
        else:
            near = points.where("x IS NOT NULL").select("id", F.array_repeat(F.lit(1.0), len(seeds)).alias("far"))
        near = near.select("id", F.posexplode("far").alias("run", "far")).where("far > 0")
        clock = -F.log(_uniform(seed, F.lit(str(t)), F.col("id").cast("string"))) / F.col("far")
        # vectors are fetched for the drawn alone: the race sorts identifiers
        place = F.row_number().over(Window.partitionBy("run").orderBy("clock", "id"))
        drawn = near.select("run", "id", clock.alias("clock")).withColumn("place", place).where(F.col("place") <= (factor * k if t else 1))
        for run, i, x in points.select("id", "x").join(F.broadcast(drawn), "id").orderBy("run", "place").select("run", "id", "x").collect():
            held[run][i] = list(x)
        if not all(held):
            break
    if not all(held):
        return [[] for _ in seeds]
    held = [dict(sorted(h.items())) for h in held]

    def nearest(parts):
        sizes = [np.zeros(len(h), np.int64) for h in held]
        for *_, squares in parts:
            for n, d in zip(sizes, squares):
                n += np.bincount(np.round(d, 9).argmin(1), minlength=len(n))
        run, c, n = zip(*[(r, c, int(n)) for r, size in enumerate(sizes) for c, n in enumerate(size)])
        yield pa.RecordBatch.from_arrays([pa.array(run, pa.int32()), pa.array(c, pa.int32()), pa.array(n, pa.int64())], names=["run", "c", "n"])

    counted = _with_distances(points, [list(h.values()) for h in held], nearest, "run int, c int, n long")
    weights = {(run, c): n for run, c, n in counted.groupBy("run", "c").agg(F.sum("n")).collect()}
    starts = []
    for r, (h, seed) in enumerate(zip(held, seeds)):
        x = np.array(list(h.values()))
        squares = ((x[:, None] - x[None]) ** 2).sum(2)
        starts.append([x[c].tolist() for c in weighted_draws(list(h), [weights.get((r, c), 0) for c in range(len(h))], squares, k, seed)])
    return starts


STARTS = {"random": random_start, "k-means++": plus_plus_start}
INITS = (*STARTS, "k-means||")


def kmeans(points: DataFrame, k: int, init: str = "k-means++", steps: int = 20, restarts: int = 10) -> tuple[DataFrame, int, float]:
    """The run of least SSE among ``restarts`` seeds, all in the same sweeps: its assignment, number and SSE; the lower number on a tie."""
    if init not in INITS:
        raise ValueError(f"init is one of {INITS}")
    mine = not points.is_cached
    kept = _dealt_evenly(points) if mine else points
    try:
        starts = oversampled_starts(kept, k, range(restarts)) if init == "k-means||" else [STARTS[init](kept, k, seed) for seed in range(restarts)]
        if not all(starts):
            raise ValueError("no points")
        centroids = lloyd_all(kept, starts, steps)[1]
        costs = {r: s for r, s in costs_all(kept, centroids).collect()}
    finally:
        if mine:
            kept.unpersist()
    best = min(costs, key=lambda r: (round(costs[r], 9), r))
    return assign(points, centroids[best]), best, costs[best]


def kmeans_mllib(vectors: DataFrame, k: int, init: str = "k-means||", max_iter: int = 300, restarts: int = 10, features: str = "features"):
    """The fit with the least cost of ``restarts`` seeds, the lower seed on a tie; ``init`` is ``random`` or ``k-means||``.

    A step of a fit is a job that takes longer to schedule than to compute, so ``SIDE_BY_SIDE`` fits run at a time; each has its own copy of the vectors cached, as MLlib does.
    """
    from pyspark import inheritable_thread_target
    from pyspark.ml.clustering import KMeans

    if init not in ("random", "k-means||"):
        raise ValueError("init is 'random' or 'k-means||'")

    def fit(seed: int):
        return KMeans(k=k, initMode=init, maxIter=max_iter, seed=seed, featuresCol=features, predictionCol="cluster").fit(vectors)

    with ThreadPool(max(1, min(restarts, SIDE_BY_SIDE))) as pool:
        models = pool.map(inheritable_thread_target(vectors.sparkSession)(fit), range(restarts), chunksize=1)
    return min(models, key=lambda m: m.summary.trainingCost)


def agglomerate(x: np.ndarray, k: int, linkage: str = "ward") -> np.ndarray:
    """Labels of bottom-up merging by Lance-Williams updates; the pair of lowest numbers goes first on a tie."""
    if linkage not in LINKAGES:
        raise ValueError(f"linkage is one of {LINKAGES}")
    n = len(x)
    squares = (x * x).sum(1)
    d = np.maximum(squares[:, None] + squares[None] - 2 * x @ x.T, 0)
    if linkage != "ward":
        d = np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    label = np.arange(n)
    for i, j, _ in merged(d, np.ones(n), k, linkage):
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def merged(d: np.ndarray, size: np.ndarray, k: int, linkage: str) -> Iterator[tuple[int, int, float]]:
    """(kept, dropped, distance) of each merge of clusters of those sizes, down to k; ``d``, infinite on its diagonal, is used up."""
    n = len(d)
    nearest = d.argmin(1)
    low = d[np.arange(n), nearest]
    alive = np.ones(n, bool)
    for _ in range(max(0, n - k)):
        i = int(low.argmin())
        j = int(nearest[i])
        i, j = min(i, j), max(i, j)
        yield i, j, float(d[i, j])
        a, b = d[i], d[j]
        if linkage == "complete":
            row = np.maximum(a, b)
        elif linkage == "average":
            row = (size[i] * a + size[j] * b) / (size[i] + size[j])
        else:
            row = ((size[i] + size) * a + (size[j] + size) * b - size * d[i, j]) / (size[i] + size[j] + size)
        row[~alive] = np.inf
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        alive[j], low[j] = False, np.inf
        size[i] += size[j]
        stale = np.flatnonzero(alive & ((nearest == i) | (nearest == j) | (row < low)))
        for s in np.union1d(stale, [i]):
            nearest[s] = d[s].argmin()
            low[s] = d[s, nearest[s]]


def agglomerative(points: DataFrame, k: int, linkage: str = "ward") -> DataFrame:
    """(id, cluster). Quadratic, so more than ``MAX_AGGLOMERATIVE`` rows are refused."""
    rows = points.orderBy("id").limit(MAX_AGGLOMERATIVE + 1).collect()
    if len(rows) > MAX_AGGLOMERATIVE:
        raise ValueError(f"agglomerative clustering takes at most {MAX_AGGLOMERATIVE} rows")
    labels = agglomerate(np.array([r[1] for r in rows], float).reshape(len(rows), -1), k, linkage) if rows else []
    return points.sparkSession.createDataFrame([(r[0], int(c)) for r, c in zip(rows, labels)], "id long, cluster int")
