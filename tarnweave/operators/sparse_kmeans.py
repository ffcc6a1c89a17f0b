"""Lloyd's k-means over a sparse matrix in long form, such as the TF-IDF cells of documents.

A document's cells are packed into one row, by numbers of their terms, and written once (``text_points`` takes them from
the texts themselves, so that neither texts nor cells are shuffled, only counts of terms). A step is one pass over
these rows: a task finds the nearest centroids of its documents from |x|^2 - 2 x.c + |c|^2 and adds up the means' sums
on the way, and the sums of the tasks, one set a core, meet by a shuffle. No cell is ever joined or shuffled, and no
document is dense. Centroids are a matrix of terms by clusters, as in MLlib's own k-means: the driver has it between two steps and
broadcasts it. Runs (restarts, or numbers of clusters) go together as long as that matrix stays below ``MAX_CELLS`` numbers; beyond, in groups of runs.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.lineage import Scratch
from .clustering import OVERSAMPLING, ROUNDS, _uniform, weighted_draws

#: Digits to which distances are compared, so that a mathematical tie goes to the lower cluster whatever the order of sums.
DIGITS = 9
#: Numbers of the centroids that one pass holds (64 MB).
MAX_CELLS = 1 << 23
#: Numbers of a piece of the sums that tasks shuffle, and candidates that are compared at a time.
PIECE, TOGETHER = 1 << 17, 64
#: Terms that a task counts documents of before it sends them on; texts of an Arrow batch, and its bytes.
COUNTED, TEXTS, TEXT_BYTES = 1 << 18, 512, 32 << 20


@dataclass
class SparsePoints:
    """All documents, one row each, with their squared lengths and their cells of positive weights."""

    rows: DataFrame  # doc_id, square, idx, w
    vocab: DataFrame  # term, idx
    n_terms: int

    @property
    def docs(self) -> DataFrame:
        return self.rows.select("doc_id", "square")

    @property
    def cells(self) -> DataFrame:
        long = self.rows.select("doc_id", F.explode(F.arrays_zip("idx", "w")).alias("c")).select("doc_id", "c.idx", "c.w")
        return long.join(F.broadcast(self.vocab), "idx").select("doc_id", "term", "w")

    def unpersist(self) -> None:
        """Nothing is cached."""


def sparse_points(weights: DataFrame, docs: DataFrame, scratch: Scratch, weight_col: str = "tfidf") -> SparsePoints:
    """Of (doc_id, term, weight) cells; documents without any are points at the origin."""
    packed = weights.groupBy("doc_id").agg(F.collect_list("term").alias("terms"), F.collect_list(F.col(weight_col).cast("double")).alias("w"))
    empty = [F.coalesce("terms", F.array().cast("array<string>")).alias("terms"), F.coalesce("w", F.array().cast("array<double>")).alias("w")]
    every = scratch.cut(docs.select("doc_id").distinct().join(packed, "doc_id", "left").select("doc_id", *empty))
    spark = every.sparkSession
    terms = every.select(F.explode("terms").alias("term")).distinct().toArrow().column("term").combine_chunks()
    terms = terms.take(pc.sort_indices(terms))
    vocab = scratch.cut(spark.createDataFrame(pa.table({"term": terms, "idx": pa.array(np.arange(len(terms), dtype=np.int32))})))
    shared = spark.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            lists, w = b.column("terms"), b.column("w")
            idx = pc.index_in(lists.flatten(), value_set=shared.value).cast(pa.int32())
            begin = pc.subtract(lists.offsets, lists.offsets[0])
            weight = w.flatten().to_numpy()
            row = np.repeat(np.arange(b.num_rows), np.diff(begin.to_numpy()))
            square = np.bincount(row, weight * weight, minlength=b.num_rows).astype(float)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(square), pa.ListArray.from_arrays(begin, idx), pa.ListArray.from_arrays(begin, w.flatten())], names=["doc_id", "square", "idx", "w"])

    rows = scratch.cut(every.mapInArrow(run, f"doc_id {every.schema['doc_id'].dataType.simpleString()}, square double, idx array<int>, w array<double>"))
    scratch.drop(every)
    return SparsePoints(rows, vocab, len(terms))


def _words(texts: pa.Array) -> Iterator[list[str]]:
    """Terms of lower-case texts, as ``functions.text.tokens`` has them."""
    find = re.compile("[a-z]{3,}").findall
    for t in texts.to_pylist():
        yield find(t) if t else []


def text_points(docs: DataFrame, scratch: Scratch, min_df: int = 50, max_df: float = 0.5, stop_words: Iterable[str] = (), id_col: str = "doc_id", text_col: str = "text") -> SparsePoints:
    """``sparse_points`` of ``tfidf.tfidf``, by two passes over the texts: documents by term, then the packed rows.

    Texts stay where they are read, unless identifiers repeat or are null: texts of one identifier are one document, and a null
    one's is a point at the origin. The kept terms go through the driver to every task.
    """
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(TEXT_BYTES))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.lower(text_col).alias("text"))
    n_docs, odd = texts.groupBy("doc_id").count().agg(F.coalesce(F.sum("count"), F.lit(0)), F.count_if((F.col("count") > 1) | F.col("doc_id").isNull())).first()
    if odd:
        texts = texts.groupBy("doc_id").agg(F.concat_ws("\n", F.collect_list("text")).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]):
        seen: Counter = Counter()

        def done():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "n"])

        for b in batches:
            for words in _words(b.column(0)):
                seen.update(set(words))
                if len(seen) >= COUNTED:
                    yield done()
                    seen = Counter()
        yield done()

    df = texts.select("text").mapInArrow(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("df"))
    kept = df.where((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df * n_docs))).where(~F.col("term").isin(sorted(stop_words))).toArrow().combine_chunks()
    kept = kept.take(pc.sort_indices(kept, [("term", "ascending")]))
    n_terms = kept.num_rows
    idf = np.log((1.0 + n_docs) / (1.0 + kept.column("df").to_numpy())) + 1
    vocab = scratch.cut(spark.createDataFrame(pa.table({"term": kept.column("term"), "idx": pa.array(np.arange(n_terms, dtype=np.int32))})))
    shared = spark.sparkContext.broadcast((kept.column("term").combine_chunks(), idf))

    def pack(batches: Iterator[pa.RecordBatch]):
        terms, idf = shared.value
        place = {t: i for i, t in enumerate(terms.to_pylist())}
        for b in batches:
            cells = []
            for row, words in enumerate(_words(b.column(1))):
                at = np.fromiter(map(place.get, words, itertools.repeat(-1)), np.int64, len(words))
                cells.append(at[at >= 0] + row * n_terms)
            null = np.asarray(b.column(0).is_null())
            key, tf = np.unique(np.concatenate([np.zeros(0, np.int64), *cells]), return_counts=True)
            row, idx = np.divmod(key, max(1, n_terms))
            row, idx, w = (x[~null[row]] for x in (row, idx, tf * idf[idx]))
            norm = np.sqrt(np.bincount(row, w * w, minlength=b.num_rows))
            w = w / norm[row]
            square = np.bincount(row, w * w, minlength=b.num_rows).astype(float)
            begin = pa.array(np.concatenate(([0], np.cumsum(np.bincount(row, minlength=b.num_rows)))), pa.int32())
            lists = [pa.ListArray.from_arrays(begin, pa.array(x)) for x in (idx.astype(np.int32), w)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(square), *lists], names=["doc_id", "square", "idx", "w"])

    rows = scratch.cut(texts.mapInArrow(pack, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, square double, idx array<int>, w array<double>"))
    return SparsePoints(rows, vocab, n_terms)


def _by_run(docs: DataFrame, runs: int) -> DataFrame:
    return docs.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1))))


def random_picks(points: SparsePoints, ks: Sequence[int], seeds: Sequence[int]) -> DataFrame:
    """(run, cluster, doc_id): in run r the ``ks[r]`` documents of the least hashes of ``seeds[r]`` and identifier."""
    at = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("run") + 1)
    u = _uniform(at(seeds).cast("string"), F.col("doc_id").cast("string"))
    place = F.row_number().over(Window.partitionBy("run").orderBy("u", "doc_id"))
    ranked = _by_run(points.docs.select("doc_id"), len(ks)).withColumn("u", u).withColumn("cluster", place - 1)
    return ranked.where((F.col("cluster") < max(ks)) & (F.col("cluster") < at(ks))).select("run", "cluster", "doc_id")


def _cells_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Squared lengths, borders of the rows' cells, numbers of terms, weights."""
    idx = batch.column("idx")
    size = np.diff(idx.offsets.to_numpy())
    return batch.column("square").to_numpy(), np.concatenate(([0], np.cumsum(size))), idx.flatten().to_numpy(), batch.column("w").flatten().to_numpy()


def _dots(begin: np.ndarray, idx: np.ndarray, w: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    out = np.zeros((len(begin) - 1, matrix.shape[1]))
    for i, (a, b) in enumerate(zip(begin[:-1], begin[1:])):
        if b > a:
            out[i] = w[a:b] @ matrix[idx[a:b]]
    return out


def _fetched(points: SparsePoints, ids: DataFrame) -> dict:
    """Packed rows of a few documents, on the driver."""
    return {r.doc_id: (r.square, np.array(r.idx, np.int32), np.array(r.w)) for r in points.rows.join(F.broadcast(ids.select("doc_id").distinct()), "doc_id").collect()}


def _candidate_blocks(held: dict, n_terms: int) -> list[tuple]:
    """Of candidates, ``TOGETHER`` at a time: identifiers, squares, place of each term among those they have, and their weights (a last row of zeros)."""
    ids, out = list(held), []
    for at in range(0, len(ids), TOGETHER):
        some = ids[at : at + TOGETHER]
        terms = np.unique(np.concatenate([held[i][1] for i in some]))
        place = np.full(n_terms, len(terms), np.int32)
        place[terms] = np.arange(len(terms))
        matrix = np.zeros((len(terms) + 1, len(some)))
        for j, i in enumerate(some):
            matrix[place[held[i][1]], j] = held[i][2]
        out.append((some, np.array([held[i][0] for i in some]), place, matrix))
    return out


def _to_candidates(batch: pa.RecordBatch, blocks: list[tuple]) -> np.ndarray:
    """Squared distances of the rows to all candidates."""
    square, begin, idx, w = _cells_of(batch)
    row = {d: i for i, d in enumerate(batch.column("doc_id").to_pylist())}
    out = []
    for ids, squares, place, matrix in blocks:
        d = np.maximum(np.round(square[:, None] + squares - 2 * _dots(begin, place[idx], w, matrix), DIGITS), 0)
        for j, i in enumerate(ids):
            if i in row:
                d[row[i], j] = 0
        out.append(d)
    return np.concatenate(out, 1)


def oversampled_picks(points: SparsePoints, k: int, seeds: Sequence[int], scratch: Scratch, rounds: int = ROUNDS, factor: int = OVERSAMPLING) -> DataFrame:
    """(run, cluster, doc_id) of k-means++ starts for all seeds together, from ``rounds`` of oversampling (see ``clustering.oversampled_starts``).

    A round is one pass over the documents. The driver gets the candidates, at most rounds * factor * k + 1 documents a run, and their weights.
    """
    spark, runs = points.rows.sparkSession, len(seeds)
    seed = F.element_at(F.array(*[F.lit(str(s)) for s in seeds]), F.col("run") + 1)
    held: dict = {}
    mine: list[list] = [[] for _ in seeds]
    id_type = points.rows.schema["doc_id"].dataType.simpleString()

    def compared(shape, schema):
        """``shape`` of the distances to all candidates and each run's columns of them, by batches."""
        order = {i: c for c, i in enumerate(held)}
        shared = spark.sparkContext.broadcast((_candidate_blocks(held, points.n_terms), [[order[i] for i in sorted(m)] for m in mine]))

        def run(batches: Iterator[pa.RecordBatch]):
            blocks, columns = shared.value
            for b in batches:
                if b.num_rows:
                    yield shape(b, _to_candidates(b, blocks), columns)

        return points.rows.mapInArrow(run, schema)

    def farness(b, d, columns):
        far = pa.array(list(np.stack([d[:, c].min(1) for c in columns], 1)), pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([b.column("doc_id"), far], names=["doc_id", "far"])

    for t in range(rounds + 1):
        if t:
            near = compared(farness, f"doc_id {id_type}, far array<double>").select("doc_id", F.posexplode("far").alias("run", "far"))
        else:
            near = _by_run(points.docs.select("doc_id"), runs).withColumn("far", F.lit(1.0))
        clock = -F.log(_uniform(seed, F.lit(str(t)), F.col("doc_id").cast("string"))) / F.col("far")
        place = F.row_number().over(Window.partitionBy("run").orderBy("clock", "doc_id"))
        drawn = near.where("far > 0").withColumn("clock", clock).withColumn("place", place).where(F.col("place") <= (factor * k if t else 1))
        new = scratch.cut(drawn.select("run", "doc_id"))
        for r in new.collect():
            mine[r.run].append(r.doc_id)
        held |= _fetched(points, new)
        if not held:
            break

    def nearest(b, d, columns):
        rows = [(r, c[j], int(n)) for r, c in enumerate(columns) for j, n in enumerate(np.bincount(d[:, c].argmin(1), minlength=len(c))) if n]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in zip(*rows)], names=["run", "candidate", "n"])

    rows = []
    if held:
        weights = {(r, c): n for r, c, n in compared(nearest, "run int, candidate int, n int").groupBy("run", "candidate").agg(F.sum("n")).collect()}
        place = {i: c for c, i in enumerate(held)}
        blocks = _candidate_blocks(held, points.n_terms)
        for r, s in enumerate(seeds):
            ids = sorted(mine[r])
            few = [held[i] for i in ids]
            batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array([f[0] for f in few], pa.float64()), pa.array([f[1] for f in few], pa.list_(pa.int32())), pa.array([f[2] for f in few], pa.list_(pa.float64()))], names=["doc_id", "square", "idx", "w"])
            squares = _to_candidates(batch, blocks)[:, [place[i] for i in ids]].T
            rows += [(r, j, ids[c]) for j, c in enumerate(weighted_draws(ids, [weights.get((r, place[i]), 0) for i in ids], squares, k, s))]
    return spark.createDataFrame(rows, points.docs.select(F.lit(0).alias("run"), F.lit(0).alias("cluster"), "doc_id").schema)


def centroids_at(points: SparsePoints, picks: DataFrame) -> DataFrame:
    """(run, cluster, term, v) of picked documents."""
    return points.cells.join(picks, "doc_id").select("run", "cluster", "term", F.col("w").alias("v"))


class _Group:
    """Runs that go together: their (run, cluster) in order, the columns of each run, and the centroids."""

    def __init__(self, slots: list[tuple[int, int]], matrix: np.ndarray):
        self.slots, self.matrix = slots, matrix
        self.columns = [(r, [j for j, s in enumerate(slots) if s[0] == r]) for r in sorted({s[0] for s in slots})]

    def model(self) -> tuple:
        return self.matrix, (self.matrix * self.matrix).sum(0), self.columns

    def moved(self, sums: np.ndarray, sizes: np.ndarray) -> _Group:
        """To the means; an empty cluster keeps its centroid."""
        there = sizes > 0
        matrix = self.matrix.copy()
        matrix[:, there] = sums[:, there] / sizes[there]
        return _Group(self.slots, matrix)


def _groups(slots: list[tuple[int, int]], n_terms: int) -> list[list[tuple[int, int]]]:
    out: list[list] = []
    for r in sorted({s[0] for s in slots}):
        some = [s for s in slots if s[0] == r]
        if out and (len(out[-1]) + len(some)) * n_terms <= MAX_CELLS:
            out[-1] += some
        else:
            out.append(some)
    return out


def _started(points: SparsePoints, picks: DataFrame) -> list[_Group]:
    of = {(r.run, r.cluster): r.doc_id for r in picks.select("run", "cluster", "doc_id").collect()}
    held, out = _fetched(points, picks), []
    for slots in _groups(sorted(of), points.n_terms):
        matrix = np.zeros((points.n_terms, len(slots)))
        for j, s in enumerate(slots):
            matrix[held[of[s]][1], j] = held[of[s]][2]
        out.append(_Group(slots, matrix))
    return out


def _nearest(batch_cells: tuple, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Column and squared distance of the nearest centroid of each run, the lower number on a tie."""
    square, begin, idx, w = batch_cells
    matrix, norms, columns = model
    d = np.round(norms - 2 * _dots(begin, idx, w, matrix), DIGITS)
    best = np.stack([np.array(c)[d[:, c].argmin(1)] for _, c in columns], 1)
    return best, np.maximum(square[:, None] + np.take_along_axis(d, best, 1), 0)


def _assigned(points: SparsePoints, group: _Group) -> DataFrame:
    shared, slots = points.rows.sparkSession.sparkContext.broadcast(group.model()), group.slots

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            if b.num_rows:
                best, d = _nearest(_cells_of(b), shared.value)
                runs, clusters = (np.array([s[i] for s in slots], np.int32)[best].ravel() for i in (0, 1))
                ids = b.column("doc_id").take(pa.array(np.repeat(np.arange(b.num_rows), best.shape[1])))
                yield pa.RecordBatch.from_arrays([ids, pa.array(runs), pa.array(clusters), pa.array(d.ravel())], names=["doc_id", "run", "cluster", "sq_dist"])

    return points.rows.mapInArrow(run, f"doc_id {points.rows.schema['doc_id'].dataType.simpleString()}, run int, cluster int, sq_dist double")


def assign(points: SparsePoints, centroids: DataFrame, clusters: DataFrame, runs: int) -> DataFrame:
    """(doc_id, run, cluster, sq_dist): the nearest centroid of each run, the lower number on a tie."""
    every = sorted((r.run, r.cluster) for r in clusters.select("run", "cluster").collect())
    found, out = centroids.join(F.broadcast(points.vocab), "term").select("run", "cluster", "idx", "v").collect(), None
    for slots in _groups(every, points.n_terms):
        matrix, place = np.zeros((points.n_terms, len(slots))), {s: j for j, s in enumerate(slots)}
        for r, c, i, v in found:
            if (r, c) in place:
                matrix[i, place[r, c]] = v
        some = _assigned(points, _Group(slots, matrix))
        out = some if out is None else out.unionByName(some)
    return out


def _step(points: SparsePoints, group: _Group, before: _Group | None) -> tuple[np.ndarray, np.ndarray, int]:
    """Sums and sizes of the clusters nearest to ``group``'s centroids, and how many rows ``before``'s had elsewhere.

    A core adds up one set of sums whatever the number of its documents, so what is shuffled doesn't grow with them.
    """
    context = points.rows.sparkSession.sparkContext
    shared = context.broadcast((group.model(), None if before is None else before.model()))
    n_terms, width = group.matrix.shape
    high = max(1, PIECE // max(1, width))

    def run(batches: Iterator[pa.RecordBatch]):
        model, old = shared.value
        sums, sizes, changed = np.zeros((n_terms, width)), np.zeros(width), 0
        for b in batches:
            if not b.num_rows:
                continue
            cells = _cells_of(b)
            best = _nearest(cells, model)[0]
            changed += 0 if old is None else int((best != _nearest(cells, old)[0]).sum())
            sizes += np.bincount(best.ravel(), minlength=width)
            _, begin, idx, w = cells
            for i, (s, e) in enumerate(zip(begin[:-1], begin[1:])):
                sums[idx[s:e, None], best[i]] += w[s:e, None]  # a document has a term once
        yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([np.append(sizes, changed).tobytes()], pa.binary())], names=["piece", "sums"])
        for p, at in enumerate(range(0, n_terms, high)):
            part = sums[at : at + high]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["piece", "sums"])

    def add(pieces: pa.Table) -> pa.Table:
        total = 0
        for raw in pieces.column("sums"):
            total = total + np.frombuffer(raw.as_py())
        return pa.table({"piece": pieces.column("piece").slice(0, 1), "sums": pa.array([total.tobytes()], pa.binary())})

    parts = points.rows.coalesce(max(1, context.defaultParallelism)).mapInArrow(run, "piece int, sums binary")
    found = {r.piece: np.frombuffer(r.sums) for r in parts.groupBy("piece").applyInArrow(add, "piece int, sums binary").collect()}
    shared.destroy()
    head = found.pop(-1, np.zeros(width + 1))
    sums = np.zeros((n_terms, width))
    for p, raw in found.items():
        sums[p * high : (p + 1) * high] = raw.reshape(-1, width)
    return sums, head[:-1], int(head[-1])


def _centroid_rows(points: SparsePoints, groups: list[_Group]) -> DataFrame:
    out = None
    for g in groups:
        shared = points.rows.sparkSession.sparkContext.broadcast((np.array(g.slots, np.int32), g.matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared):
            slots, matrix = shared.value
            for b in batches:
                part = matrix[b.column("idx").to_numpy()]
                row, slot = np.nonzero(part)
                yield pa.RecordBatch.from_arrays([pa.array(slots[slot, 0]), pa.array(slots[slot, 1]), b.column("term").take(pa.array(row)), pa.array(part[row, slot])], names=["run", "cluster", "term", "v"])

        some = points.vocab.mapInArrow(run, "run int, cluster int, term string, v double")
        out = some if out is None else out.unionByName(some)
    return out


@dataclass
class SparseClustering:
    assigned: DataFrame  # doc_id, run, cluster, sq_dist
    centroids: DataFrame  # run, cluster, term, v
    steps: int


def lloyd(points: SparsePoints, picks: DataFrame, runs: int, scratch: Scratch, steps: int = 300, until_stable: bool = True) -> SparseClustering:
    """Steps of all runs together, at most ``steps``, then the assignment to the last centroids.

    With ``until_stable`` it ends as soon as no document changes its cluster in any run.
    """
    now, before, done = _started(points, picks), None, 0
    while True:
        if done == steps or not now:
            break
        after, changed = [], 0
        for i, g in enumerate(now):
            sums, sizes, other = _step(points, g, before[i] if before and until_stable else None)
            after.append(g.moved(sums, sizes))
            changed += other
        if before and until_stable and not changed:
            break
        before, now, done = now, after, done + 1
    assigned = None
    for g in now:
        some = _assigned(points, g)
        assigned = some if assigned is None else assigned.unionByName(some)
    if assigned is None:
        none = points.docs.limit(0).select("doc_id", F.lit(0).alias("run"), F.lit(0).alias("cluster"), F.col("square").alias("sq_dist"))
        return SparseClustering(none, points.rows.sparkSession.createDataFrame([], "run int, cluster int, term string, v double"), 0)
    return SparseClustering(scratch.cut(assigned), _centroid_rows(points, now), done)


def costs(assigned: DataFrame) -> DataFrame:
    """(run, sse)."""
    return assigned.groupBy("run").agg(F.sum("sq_dist").alias("sse"))


def best_run(clustering: SparseClustering) -> tuple[int, float]:
    """The run of least SSE, the lower number on a tie, and its SSE."""
    return min(((r, s) for r, s in costs(clustering.assigned).collect()), key=lambda x: (round(x[1], DIGITS), x[0]))


def centroid_top_terms(centroids: DataFrame, k: int = 10) -> DataFrame:
    """(cluster, place, term, weight): the greatest centroid weights, alphabetical on a tie."""
    rounded = centroids.select("cluster", "term", F.round("v", DIGITS).alias("weight"))
    place = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("weight"), "term"))
    return rounded.select("cluster", place.alias("place"), "term", "weight").where(F.col("place") <= k)
