import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.operators import sparse_kmeans as S
from tarnweave.plans.lineage import Scratch

TERMS = ["t%d" % i for i in range(12)]


def points_of(spark, x):
    cells = [(d, TERMS[t], float(v)) for d, row in enumerate(x) for t, v in enumerate(row) if v]
    docs = spark.createDataFrame([(d,) for d in range(len(x))], "doc_id long")
    return S.sparse_points(spark.createDataFrame(cells, "doc_id long, term string, tfidf double"), docs, Scratch(spark, "points"))


def some(n=40, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 12)) * (rng.random((n, 12)) < 0.4)
    x[5] = 0  # no term at all
    x[7] = x[6]
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(norm, norm, 1)


def slow(x, picks, steps):
    c = x[picks].copy()
    for step in range(steps + 1):
        d = np.round(((x[:, None] - c) ** 2).sum(2), 9)
        label = d.argmin(1)
        if step < steps:
            c = np.array([x[label == k].mean(0) if (label == k).any() else c[k] for k in range(len(c))])
    return label, d.min(1), c


def test_lloyd_against_dense(spark):
    """Several runs together, with a document without terms, equal documents, and centroids at the origin, equal and without members."""
    x, starts = some(), [[0, 1, 2], [5, 6, 7], [7, 6, 5]]
    points = points_of(spark, x)
    picks = spark.createDataFrame([(r, c, d) for r, s in enumerate(starts) for c, d in enumerate(s)], "run int, cluster int, doc_id long")
    found = S.lloyd(points, picks, 3, Scratch(spark, "t"), 4, until_stable=False)
    got, centroids = found.assigned.collect(), found.centroids.collect()
    for r, s in enumerate(starts):
        label, d, c = slow(x, s, 4)
        assert [g.cluster for g in sorted(got, key=lambda g: g.doc_id) if g.run == r] == label.tolist()
        assert [g.sq_dist for g in sorted(got, key=lambda g: g.doc_id) if g.run == r] == pytest.approx(d.tolist(), abs=1e-8)
        cells = {(z.cluster, z.term): z.v for z in centroids if z.run == r}
        assert cells == {(k, TERMS[t]): pytest.approx(v) for k, row in enumerate(c) for t, v in enumerate(row) if v}
    best, sse = S.best_run(found)
    sums = [slow(x, s, 4)[1].sum() for s in starts]
    assert best == int(np.argmin(np.round(sums, 6))) and sse == pytest.approx(min(sums), abs=1e-6)


def test_stops_when_stable(spark):
    x = np.zeros((12, 12))
    x[np.arange(12), np.arange(12) // 4] = 1  # three groups without a common term
    points = points_of(spark, x)
    picks = spark.createDataFrame([(0, 0, 0), (0, 1, 4), (0, 2, 8)], "run int, cluster int, doc_id long")
    found = S.lloyd(points, picks, 1, Scratch(spark, "t"))
    assert found.steps == 1 and S.best_run(found) == (0, 0.0)
    assert {r.cluster for r in found.assigned.where("doc_id < 4").collect()} == {0}


def test_no_dense_vector_in_the_plan(spark):
    points = points_of(spark, some())
    picks = S.random_picks(points, [2, 3], [0, 1])
    plan = S.assign(points, S.centroids_at(points, picks), picks, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "BatchEvalPython" not in plan and "from_json" not in plan
    assert sorted((r.run, r.cluster) for r in picks.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1), (1, 2)]


def test_starts(spark):
    """Four groups without common terms: oversampled starts take one of each, whatever the seed and the partitioning."""
    rng, x = np.random.default_rng(2), np.zeros((40, 12))
    for d in range(40):
        x[d, 3 * (d % 4) : 3 * (d % 4) + 3] = 1 + 0.01 * rng.random(3)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    points, scratch = points_of(spark, x), Scratch(spark, "t")
    picks = S.oversampled_picks(points, 4, range(3), scratch).collect()
    assert all(sorted(p.doc_id % 4 for p in picks if p.run == r) == [0, 1, 2, 3] for r in range(3))
    few = points_of(spark, np.repeat(x[:1], 5, 0))
    assert [(p.run, p.cluster) for p in S.oversampled_picks(few, 3, [1], scratch).collect()] == [(0, 0)]


def test_empty(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    cells = spark.createDataFrame([], "doc_id long, term string, tfidf double")
    points = S.sparse_points(cells, docs, Scratch(spark, "t"))
    found = S.lloyd(points, S.random_picks(points, [2], [0]), 1, Scratch(spark, "t"))
    assert {(r.doc_id, r.cluster, r.sq_dist) for r in found.assigned.collect()} == {(1, 0, 0.0), (2, 0, 0.0)}
    assert found.centroids.count() == 0 and S.centroid_top_terms(found.centroids).count() == 0


def test_counting_by_the_write_itself(spark):
    before = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or [])
    out, seen = Scratch(spark, "t").cut_counting(spark.range(100).withColumn("old", F.col("id") % 3), ["id"], n=F.count(F.lit(1)), change=F.sum("old"))
    after = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None) or [])
    assert seen == {"n": 100, "change": 99} and after - before == 1 and out.columns == ["id"] and out.count() == 100
    assert math.isclose(sum(r.id for r in out.collect()), 4950)


def test_cells_are_never_joined(spark, monkeypatch):
    """The assignment is one pass without a join or shuffle, and runs that don't fit together give the same."""
    x = some()
    points = points_of(spark, x)
    picks = spark.createDataFrame([(r, c, d) for r, s in enumerate([[0, 1, 2], [5, 6, 7]]) for c, d in enumerate(s)], "run int, cluster int, doc_id long")
    plan = S.assign(points, S.centroids_at(points, picks), picks, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan
    rows = lambda f: sorted((r.doc_id, r.run, r.cluster, round(r.sq_dist, 8)) for r in f.assigned.collect())
    together = rows(S.lloyd(points, picks, 2, Scratch(spark, "t"), 3, until_stable=False))
    monkeypatch.setattr(S, "MAX_CELLS", 1)
    assert rows(S.lloyd(points, picks, 2, Scratch(spark, "t"), 3, until_stable=False)) == together


def test_tasks_of_tfidf_by_bytes(spark, monkeypatch):
    from tarnweave.operators import tfidf as V

    docs = spark.createDataFrame([(d, f"alpha beta gamma{'abc'[d % 3]}") for d in range(30)], "doc_id long, text string")
    want = sorted(map(tuple, V.tfidf(docs, 1, 1.0).collect()))
    monkeypatch.setattr(V, "TASK_BYTES", 20)
    many = V.tfidf(docs, 1, 1.0)
    size = docs.selectExpr("sum(octet_length(text))").first()[0]
    assert f", {-(-size // 20)})" in many._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, many.collect())) == want


@pytest.mark.parametrize("counted", [1 << 18, 2])
def test_points_from_texts(spark, monkeypatch, counted):
    """The same points as from the cells of tfidf, with texts null, empty and of letters that only lower-casing makes a-z, and repeated and null identifiers."""
    from tarnweave.operators import tfidf as V

    monkeypatch.setattr(S, "COUNTED", counted)
    texts = ["alpha beta beta gamma", None, "", "ALPHA délta Kappa alphabeta", "beta gamma delta", "12 ab", "alpha alpha gamma kappa", "kappa beta-gamma\nalpha"]
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    twice = plain.unionByName(spark.createDataFrame([(4, "alpha kappa"), (1, "gamma"), (None, "beta kappa"), (None, "kappa")], plain.schema))
    for docs in (plain.repartition(3), twice.repartition(3), plain.limit(0)):
        for stop in ((), ("alpha",)):
            want = S.sparse_points(V.tfidf(docs, 2, 0.8, stop), docs, Scratch(spark, "old"))
            got = S.text_points(docs, Scratch(spark, "new"), 2, 0.8, stop)
            assert got.n_terms == want.n_terms and sorted(map(tuple, got.vocab.collect())) == sorted(map(tuple, want.vocab.collect()))
            rows = lambda p: {r.doc_id: (r.square, dict(zip(r.idx, r.w))) for r in p.rows.collect()}
            a, b = rows(got), rows(want)
            assert got.rows.count() == want.rows.count() and set(a) == set(b) and got.rows.schema == want.rows.schema
            assert all(a[d][0] == pytest.approx(b[d][0]) and a[d][1] == pytest.approx(b[d][1]) for d in a)


def test_document_queries_shuffle_no_cells(spark, monkeypatch):
    """The queries' points come from the texts, and none of their plans moves a text."""
    from tarnweave.plans import queries as Q

    monkeypatch.setattr(Q.V, "tfidf", None)
    plan = Q.docs_kmeans_top_docs(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert moved and not any("text" in line for line in moved)
