import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm.embedding_links import Directions, build_balls, calibrated, collisions, link, unit_rows
from tarnweave.llm.common import Scratch

SCHEMA = "vec_id long, embedding array<float>, x binary, uid long, ball long, mult long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], b"", 1, 2, 3) for i, v in rows], SCHEMA)


def brute(rows, threshold=0.9):
    """(id, links, component, kept) of each row by all pairs, in order."""
    width = max([len(v) for _, v in rows if v is not None] + [1])
    x = np.zeros((len(rows), width))
    for k, (_, v) in enumerate(rows):
        if v is not None and all(c is not None for c in v) and np.isfinite(np.float32(v)).all():
            x[k, : len(v)] = np.float32(v).astype(float)
    norm = np.linalg.norm(x / np.maximum(np.abs(x).max(1), 1e-300)[:, None], axis=1) * np.abs(x).max(1)
    u = x / np.where(norm > 0, norm, 1)[:, None]
    linked = (u @ u.T >= threshold) & (norm > 0)[:, None] & (norm > 0)
    np.fill_diagonal(linked, False)
    root = np.arange(len(rows))
    while True:
        low = np.minimum(root, np.where(linked, root, len(rows)).min(1, initial=len(rows)))
        if (low == root).all():
            break
        root = low
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in np.flatnonzero(root == root[k]) if rows[m][0] is not None]
        least = min(ids) if ids else None
        out.append((i, int(linked[k].sum()), least, i is not None and i == least))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def around(rng, centre, n, cosine):
    """n vectors at about this cosine to the centre."""
    y = rng.standard_normal((n, len(centre)))
    y -= (y @ centre)[:, None] * centre
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return cosine * centre + np.sqrt(1 - cosine**2) * y


def unit(rng, n, width=64):
    v = rng.standard_normal((n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_groups_against_all_pairs(spark):
    """Lone vectors, tight groups, a loose one that takes several balls, exact copies, chains, and all labels alike."""
    rng = np.random.default_rng(3)
    found = [unit(rng, 300), around(rng, unit(rng, 1)[0], 120, 0.99), around(rng, unit(rng, 1)[0], 200, 0.955), np.repeat(unit(rng, 2), 30, 0), around(rng, unit(rng, 1)[0], 60, 0.93)]
    a, b = unit(rng, 2)
    b -= (a @ b) * a
    b /= np.linalg.norm(b)
    found.append(np.array([np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 3, 0.4)]))  # each links with its neighbours alone
    rows = list(enumerate(np.concatenate(found) * rng.uniform(0.5, 3, (sum(map(len, found)), 1))))
    order = rng.permutation(len(rows))
    rows = [(int(order[i]), v) for i, v in rows]
    got, want = result(link(frame(spark, rows).repartition(4))), brute(rows)
    assert got == want and sum(r[1] for r in want) > 20_000


def test_recall_at_the_threshold():
    rng = np.random.default_rng(8)
    for n in (50, 3000, 200_000):
        directions, enough = calibrated(64, n, 0.9, 0.995, 42)
        assert enough >= 2
        # pairs that the calibration has not seen
        assert directions.calibrate(0.9, 64, 0.98, pairs=1500, seed=int(rng.integers(99, 999))) >= enough


def test_strangers_are_rare():
    rng = np.random.default_rng(1)
    d = Directions(64, 20_000, 0.9, 42)
    row, _, value = d.ends(unit(rng, 500))
    assert (value >= d.tail).all() and len(row) / 500 < 90
    # against all directions
    x = unit(rng, 20)
    r, direction, value = d.ends(x)
    n, seen = 2 * d.half, set(zip(r.tolist(), direction.tolist()))
    for t, codes in enumerate(d.codes):
        left, right = (np.concatenate((x @ c, -(x @ c)), 1) for c in codes)
        for k, i, j in zip(*np.nonzero(left[:, :, None] + right[:, None, :] >= d.tail)):
            seen.remove((int(k), int((t * n + i) * n + j)))
    assert not seen


def test_collisions_against_pairs(spark):
    rng = np.random.default_rng(6)
    rows = [(int(d), int(b), float(low), float(low + rng.choice([0, 0.5]))) for b in range(60) for d, low in zip(range(8), rng.uniform(0, 4, 8))]
    want = {}
    for d, a, low, high in rows:
        for e, b, other, top in rows:
            if d == e and a < b and other <= high + 1 and low <= top + 1:
                want[a, b] = want.get((a, b), 0) + 1
    df = spark.createDataFrame(rows, "direction long, ball long, low double, high double").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # windows go over batches
    assert {(r.a, r.b): r.n for r in collisions(df, 1.0).collect()} == want


def test_balls_are_cliques(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([unit(rng, 40), around(rng, unit(rng, 1)[0], 200, 0.985)])
    unit_df = unit_rows(frame(spark, list(enumerate(x))), "vec_id", "embedding", 64)
    balls = build_balls(unit_df.select(F.col("id").alias("uid"), "x"), 64, 0.9, len(x), Scratch(spark, "t"), 1).collect()
    assert sorted(r.uid for r in balls) == list(range(len(x))) and len({r.ball for r in balls}) < 150
    for ball in {r.ball for r in balls}:
        mine = x[[r.uid for r in balls if r.ball == ball]]
        assert (mine @ mine.T >= 0.9).all()


@pytest.mark.parametrize("threshold", [0.9, 0.8])
def test_odd_rows(spark, threshold):
    rng = np.random.default_rng(2)
    v = unit(rng, 6, 5)
    rows = [
        (1, None), (2, []), (3, [0.0] * 5), (4, [1.0, None, 0, 0, 0]), (5, [float("nan")] * 5), (6, [float("inf"), 0, 0, 0, 0]), (7, [1.0]), (8, [2.0, -0.0]), (8, [2.0, -0.0]), (None, [3.0, 0, 0, 0, 0]), (None, v[3]), (None, v[3] * 2),
        (9, [1e-38] * 5), (10, [3e38] * 5), (11, v[0]), (11, v[1]), (12, v[1] * 7), (13, -v[1]),
    ]
    got = link(frame(spark, rows).repartition(3), threshold)
    assert got.columns == ["id", "n_links", "component_id", "kept"] and result(got) == brute(rows, threshold)


def test_empty(spark):
    assert link(frame(spark, [])).count() == 0
    assert result(link(frame(spark, [(1, None)]))) == [(1, 0, 1, True)]
