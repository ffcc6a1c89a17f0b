import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.functions import text as T
from tarnweave.operators import clustering as C
from tarnweave.operators import evaluation as E
from tarnweave.operators import tfidf as V

G5 = list(zip(range(8), [0, 1, 0, 1, 0, 1, 0, 1], ["sports", "music", "music", "sports", "sports", "music", "music", "sports"]))
G6 = {0: (239, 0, 0), 1: (1, 161, 0), 2: (44, 590, 19), 3: (0, 2, 108), 4: (0, 209, 0)}


def assigned(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, cluster int, category string")


def test_small_metrics(spark):
    a = assigned(spark, G5)
    assert E.purity(a).first()[0] == 0.5
    assert tuple(E.entropies(a).first()) == (pytest.approx(1), pytest.approx(2), pytest.approx(1))
    assert {tuple(r) for r in E.cluster_modes(a).collect()} == {(0, "music", 2), (1, "music", 2)}
    assert sorted(map(tuple, E.docs_per_cluster(a).collect())) == [(i % 2, i, 4) for i in (0, 2, 4, 6, 1, 3, 5, 7)]
    assert E.majority_share(a).first()[0] == 0.5


def test_contingency_table(spark):
    rows, k = [], 0
    for cluster, counts in G6.items():
        for name, n in zip(("music", "politics", "sports"), counts):
            rows += [(k + i, cluster, name) for i in range(n)]
            k += n
    a = assigned(spark, rows)
    assert E.purity(a).first()[0] == pytest.approx(0.951930, abs=1e-6)
    weighted, _, overall = E.entropies(a).first()
    assert weighted == pytest.approx(0.275121, abs=1e-6) and overall == pytest.approx(1.147509, abs=1e-6)


def test_categories_skip_empty(spark):
    a = assigned(spark, [(1, 0, "x"), (2, 0, ""), (3, 0, None)])
    assert [r[0] for r in E.categories(a).collect()] == ["x"]


def test_text_functions(spark):
    df = spark.createDataFrame([("One two. Three",), ("no stop",), ("x" * 101,)], "t string")
    assert [r[0] for r in df.select(T.word_size(F.col("t"))).collect()] == [3, 2, 1]
    assert [r[0] for r in df.select(T.first_sentence(F.col("t"))).collect()] == ["One two", "no stop", "x" * 101]
    assert [r[0] for r in df.select(T.snippet(F.col("t"))).collect()][2] == "x" * 100 + "..."
    one = spark.createDataFrame([("The the March foo ab",)], "t string")
    assert one.select(T.tokens(F.col("t"), {"march"})).first()[0] == ["the", "the", "foo"]
    assert "march" in T.default_stop_words()
    shown = spark.createDataFrame([("a", None, "b")], "t string, c string, x string").select(T.display(F.col("t"), F.col("c"), F.col("x"))).first()[0]
    assert shown == "a\nb"


def test_tfidf_by_hand(spark):
    docs = spark.createDataFrame([(1, "aaa bbb bbb"), (2, "aaa ccc"), (3, "ccc"), (4, "zz")], "doc_id long, text string")
    got = {(r.doc_id, r.term): r.tfidf for r in V.tfidf(docs, 1, 0.5).collect()}
    idf = lambda df: math.log(5 / (1 + df)) + 1
    a, b, c = idf(2), 2 * idf(1), idf(2)
    assert got == {(1, "aaa"): pytest.approx(a / math.hypot(a, b)), (1, "bbb"): pytest.approx(b / math.hypot(a, b)), (2, "aaa"): pytest.approx(a / math.hypot(a, c)), (2, "ccc"): pytest.approx(c / math.hypot(a, c)), (3, "ccc"): pytest.approx(1)}
    vocab = V.vocabulary(V.kept_terms(V.document_frequency(V.term_frequency(docs)), 4, 1, 0.5))
    vectors = V.to_vectors(docs, vocab, 4)
    place = {r.term: r.idx for r in vocab.collect()}
    cells = {r.doc_id: r.features.toArray().tolist() for r in vectors.collect()}
    assert all(cells[d][place[t]] == pytest.approx(w, abs=1e-9) for (d, t), w in got.items())
    assert sum(x > 0 for c in cells.values() for x in c) == len(got) and cells[4] == [0, 0, 0]
    assert "BatchEvalPython" not in vectors._jdf.queryExecution().toString()
    assert V.to_vectors(docs, vocab.where("false"), 4).first().features.toArray().tolist() == [0]


def test_lloyd_against_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    c = x[:4].copy()
    for _ in range(3):
        label = ((x[:, None] - c) ** 2).sum(2).argmin(1)
        c = np.array([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(4)])
    d = ((x[:, None] - c) ** 2).sum(2)
    out, centroids = C.lloyd(points, 4, 3)
    assert np.allclose(centroids, c)
    assert {r.id: r.cluster for r in out.collect()} == dict(enumerate(d.argmin(1)))
    assert C.sse(out).first()[0] == pytest.approx(d.min(1).sum())
    curve = C.sse_by_k(points, (2, 4)).collect()
    assert [r.k for r in curve] == [2, 4] and curve[1].sse == pytest.approx(d.min(1).sum())


def test_bounds_against_all_distances(spark):
    """The same clusters as without bounds, ties included, from less than half of the distances once centroids settle."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(60, 3)) * 0.3 + 4 * np.eye(3)[c] for c in range(3)] + [[[0.0, 0, 0]] * 2])
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    start = [x[0].tolist(), x[1].tolist(), x[70].tolist(), x[130].tolist()]
    for steps in (0, 1, 6):
        bounded, (plain, centroids) = C.lloyd_bounded(points, 4, steps, start), C.lloyd(points, 4, steps, start)
        got = {r.id: (r.cluster, pytest.approx(r.sq_dist)) for r in bounded.assigned.collect()}
        assert {r.id: (r.cluster, r.sq_dist) for r in plain.collect()} == got and np.allclose(bounded.centroids, centroids)
    assert len(bounded.computed) == 7 and bounded.computed[0] == 4 * len(x) and all(n < 2 * len(x) for n in bounded.computed[3:])
    twins = spark.createDataFrame([(i, [float(i % 2)]) for i in range(6)], "id long, x array<double>")
    same = C.lloyd_bounded(twins, 3, 2, [[0.0], [0.0], [1.0]])
    assert {r.id: r.cluster for r in same.assigned.collect()} == {i: 2 * (i % 2) for i in range(6)}
    assert C.lloyd_bounded(twins, 1, 1).assigned.agg({"sq_dist": "sum"}).first()[0] == pytest.approx(1.5)
    assert C.lloyd_bounded(twins.limit(0), 2).assigned.count() == 0


def test_mllib(spark):
    from pyspark.ml.linalg import Vectors

    data = spark.createDataFrame([(float(i), Vectors.dense([i // 10 * 10.0 + i % 2 * 0.01, i % 3 * 0.1])) for i in range(30)], ["id", "features"])
    for init in ("random", "k-means||"):
        model = C.kmeans_mllib(data, 3, init)
        assert model.summary.trainingCost < 1
    with pytest.raises(ValueError):
        C.kmeans_mllib(data, 3, "other")


def _merge_slowly(x, k, linkage):
    groups = [[i] for i in range(len(x))]
    dist = lambda a, b: np.sqrt(((x[a][:, None] - x[b][None]) ** 2).sum(2))

    def far(a, b):
        d = dist(a, b)
        if linkage == "complete":
            return d.max()
        if linkage == "average":
            return d.mean()
        return len(a) * len(b) / (len(a) + len(b)) * ((x[a].mean(0) - x[b].mean(0)) ** 2).sum()

    while len(groups) > k:
        _, i, j = min((far(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("linkage", C.LINKAGES)
def test_agglomerative_against_slow_merging(spark, linkage):
    x = np.random.default_rng(5).normal(size=(25, 2))
    labels = C.agglomerate(x, 4, linkage)
    got = {frozenset(np.flatnonzero(labels == c).tolist()) for c in set(labels)}
    assert got == _merge_slowly(x, 4, linkage)
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    assert C.agglomerative(points, 4, linkage).count() == 25
    with pytest.raises(ValueError):
        C.agglomerate(x, 4, "single")


def test_agglomerative_bound(spark, monkeypatch):
    monkeypatch.setattr(C, "MAX_AGGLOMERATIVE", 3)
    points = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "id long, x array<double>")
    with pytest.raises(ValueError):
        C.agglomerative(points, 2)


def test_top_docs_ties(spark):
    a = spark.createDataFrame([(3, 0, 5), (1, 0, 5), (2, 0, 9)], "doc_id long, cluster int, word_size long")
    assert [r.doc_id for r in E.top_docs(a, 2).orderBy("place").collect()] == [2, 1]


def test_starts(spark):
    """Four tight groups far apart: k-means++ takes a point of each, whatever the seed."""
    rows = [(i, [100.0 * (i % 4) + i * 1e-3, 0.0]) for i in range(40)]
    points = spark.createDataFrame(rows, "id long, x array<double>")
    for seed in range(5):
        assert {round(c[0] / 100) for c in C.plus_plus_start(points, 4, seed)} == {0, 1, 2, 3}
        assert len({c[0] for c in C.random_start(points, 4, seed)}) == 4
    starts = C.oversampled_starts(points, 4, range(5))
    assert all({round(c[0] / 100) for c in s} == {0, 1, 2, 3} for s in starts) and starts == C.oversampled_starts(points.repartition(3), 4, range(5))
    assigned, _, cost = C.kmeans(points, 4, init="k-means||", restarts=3, steps=5)
    assert cost < 0.1
    assigned, _, cost = C.kmeans(points, 4, restarts=3, steps=5)
    assert cost < 0.1 and assigned.groupBy("cluster").count().where("count = 10").count() == 4
    same = spark.createDataFrame([(i, [1.0]) for i in range(3)], "id long, x array<double>")
    assert len(C.plus_plus_start(same, 2)) == 1 and [len(s) for s in C.oversampled_starts(same, 2, (0, 1))] == [1, 1]
    with pytest.raises(ValueError):
        C.kmeans(points, 2, "other")
    with pytest.raises(ValueError):
        C.kmeans(points.limit(0), 2)
    with pytest.raises(ValueError):
        C._literal([[0.0] * C.MAX_CONSTANT, [0.0]])


def test_steps_send_means_of_tasks(spark):
    """A row a cluster and task goes on from a step, costs and starts, whatever the number of points; null vectors take no part, as in SQL."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 4))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)]
    points = spark.createDataFrame(rows, "id long, x array<double>").repartition(2)
    starts, sent = [x[:3].tolist(), x[5:7].tolist()], []
    means = C._means
    with pytest.MonkeyPatch.context() as m:
        m.setattr(C, "_means", lambda parts, previous: sent.append(parts.count()) or means(parts, previous))
        _, centroids = C.lloyd_all(points, starts, 2)
    assert len(sent) == 2 and max(sent) <= 5 * spark.sparkContext.defaultParallelism
    for c, start in zip(centroids, starts):
        c2 = np.array(start)
        for _ in range(2):
            label = ((x[:, None] - c2) ** 2).sum(2).argmin(1)
            c2 = np.array([x[label == j].mean(0) for j in range(len(c2))])
        assert np.allclose(c, c2)
    assigned, _, cost = C.kmeans(points, 3, "k-means||", 2, 2)
    assert assigned.count() == 3000 and cost == pytest.approx(C.sse(assigned).first()[0])


def test_mllib_fits_side_by_side(spark, monkeypatch):
    import threading

    from pyspark.ml.clustering import KMeans
    from pyspark.ml.linalg import Vectors

    data = spark.createDataFrame([(float(i), Vectors.dense([float(i % 7), float(i % 3)])) for i in range(30)], ["id", "features"])
    both, fit = threading.Barrier(2, timeout=60), KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, df: both.wait() is not None and fit(self, df))
    model = C.kmeans_mllib(data, 3, "random", restarts=2)
    monkeypatch.undo()
    alone = [KMeans(k=3, initMode="random", maxIter=300, seed=s, predictionCol="cluster").fit(data) for s in (0, 1)]
    assert model.summary.trainingCost == min(m.summary.trainingCost for m in alone)
