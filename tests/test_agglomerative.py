"""Agglomerative clustering in rounds against merging in one matrix."""

import numpy as np
import pytest

from tarnweave.operators import agglomerative as A
from tarnweave.operators import clustering as C


@pytest.mark.parametrize("linkage", C.LINKAGES)
def test_rounds_against_one_matrix(spark, monkeypatch, linkage):
    """More rows than the matrix takes: groups of unequal size, an outlier pair (merged early, undone by the cut), and copies."""
    monkeypatch.setattr(C, "MAX_AGGLOMERATIVE", 3)
    monkeypatch.setattr(A, "LAST", 25)
    monkeypatch.setattr(A, "BLOCK", 16)
    rng = np.random.default_rng(4)
    x = np.concatenate((rng.normal(size=(70, 4)), rng.normal(size=(20, 4)) + 9, [[300.0] * 4, [420.0] * 4], np.zeros((5, 4))))
    points = spark.createDataFrame([(7 * i + 3, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = A.agglomerative_in_rounds(points, 4, linkage).orderBy("id").collect()
    assert [r.id for r in got] == [7 * i + 3 for i in range(len(x))]
    assert [r.cluster for r in got] == C.agglomerate(x, 4, linkage).tolist()


def test_fewer_vectors_than_clusters(spark):
    points = spark.createDataFrame([(i, [float(i // 3)]) for i in range(6)], "id long, x array<double>")
    got = A.agglomerative_in_rounds(points, 3).orderBy("id").collect()
    assert [r.cluster for r in got] == C.agglomerate(np.array([[i // 3] for i in range(6)], float), 3).tolist()


@pytest.mark.parametrize("linkage", C.LINKAGES)
def test_a_pass_merges_many_rounds(spark, monkeypatch, linkage):
    """Comparing all points is what takes time: a pass with lists of eight clusters saves several rounds of mutual nearest pairs."""
    monkeypatch.setattr(A, "LAST", 20)
    monkeypatch.setattr(A, "BLOCK", 64)
    monkeypatch.setattr(A, "PAIRS", 2400, raising=False)
    compared, passes = A._compared, []
    monkeypatch.setattr(A, "_compared", lambda *a: passes.append(1) or compared(*a))
    x = np.random.default_rng(8).normal(size=(300, 6))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = A.agglomerative_in_rounds(points, 5, linkage).orderBy("id").collect()
    assert [r.cluster for r in got] == C.agglomerate(x, 5, linkage).tolist()
    assert len(passes) <= 9


@pytest.mark.parametrize("dense", (0, 60, 1000))
@pytest.mark.parametrize("linkage", ("average", "complete"))
def test_distances_in_a_table(spark, monkeypatch, linkage, dense):
    """Points are compared until ``DENSE`` clusters are left, whose distances are summed from then on; one cluster is in several blocks."""
    monkeypatch.setattr(A, "LAST", 12)
    monkeypatch.setattr(A, "BLOCK", 32)
    monkeypatch.setattr(A, "PAIRS", 900)
    monkeypatch.setattr(A, "DENSE", dense)
    blocks, made = A._blocks, []
    monkeypatch.setattr(A, "_blocks", lambda *a: made.append(1) or blocks(*a))
    rng = np.random.default_rng(9)
    x = np.concatenate((rng.normal(size=(50, 4)) * 0.01, rng.normal(size=(100, 4)) + 5))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>")
    got = A.agglomerative_in_rounds(points, 4, linkage).orderBy("id").collect()
    assert [r.cluster for r in got] == C.agglomerate(x, 4, linkage).tolist()
    assert len(made) == 1 if dense == 1000 else len(made) > 1
