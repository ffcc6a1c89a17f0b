import math
import random

from pyspark.sql import functions as F

from tarnweave.llm.hard_negatives import mine

SCHEMA = "vec_id long, embedding array<float>, label int, score long, id long, tile string"


def brute(rows, positives=5, negatives=5):
    usable = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    usable = [r for r in usable if sum(x * x for x in r[2]) <= 1 << 53]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for n, (i, label, v) in enumerate(usable):
        if i % 10:
            continue
        scored = [(-dot(v, w), j, other) for m, (j, other, w) in enumerate(usable) if m != n]
        for s, j, _ in sorted(x for x in scored if x[2] == label)[:positives]:
            window = sorted((t, k) for t, k, other in scored if other != label and 80 * -s <= 100 * -t <= 100 * -s)
            out += [(i, j, rank, k, -s, -t) for rank, (t, k) in enumerate(window[:negatives], 1)]
    return sorted(out)


def some(n, width=7, seed=1):
    rng = random.Random(seed)
    return [(i, [rng.gauss(0.05, 0.2) for _ in range(width)], rng.choice([0, 1, 1, 2])) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, 2, "x") for i, v, label in rows], SCHEMA)


def as_floats(rows):
    """What the float column holds."""
    import numpy as np

    return [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]


def test_against_all_pairs(spark):
    rows = some(160)
    df = frame(spark, rows)
    want = brute(as_floats(rows))
    for parts, chunk, side in ((1, 32, 4), (5, 3, 2)):  # one block and one chunk; several of both
        assert sorted(map(tuple, mine(df.repartition(parts), F.col("vec_id") % 10 == 0, chunk=chunk, side=side).collect())) == want
    assert len(want) > 100


def test_odd_rows(spark):
    """Nulls, other lengths, ties, repeated rows, components too large or not finite, one hot label."""
    base = some(60, seed=4)
    odd = [
        (None, [0.1] * 7, 1), (500, None, 1), (510, [0.1] * 7, None), (520, [0.1, None, 0.1], 1), (530, [float("nan")] * 7, 1), (540, [float("inf")] * 7, 0), (550, [1e30] * 7, 1), (560, [], 1), (570, [0.3, 0.2], 0),
        (580, [0.0] * 7, 2), *[base[10]] * 2, *[(600 + i, base[20][1], 1) for i in range(40)], *[(700 + i, base[20][1], 2) for i in range(9)],
    ]
    rows = [*base, *odd]
    got = mine(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, chunk=4)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(map(tuple, got.collect())) == brute(as_floats(rows))


def test_empty(spark):
    assert mine(frame(spark, []), F.col("vec_id") % 10 == 0).count() == 0
    assert mine(frame(spark, [(10, None, 1), (20, [0.5], 1)]), F.col("vec_id") % 10 == 0).count() == 0


def test_no_scores_are_written(spark, monkeypatch):
    """The tables between the passes hold blocks and positives, no tile of anchors times rows; several cells of both kinds give the same."""
    from tarnweave.llm import hard_negatives as H

    rows, names = some(160), []
    cut = H.Scratch.cut
    monkeypatch.setattr(H.Scratch, "cut", lambda self, df, *a: names.extend(df.columns) or cut(self, df, *a))
    monkeypatch.setattr(H, "SLICE", 3)
    monkeypatch.setattr(H, "BLOCK_BITS", 3)
    got = mine(frame(spark, rows).repartition(3), F.col("vec_id") % 10 == 0, chunk=3, side=1)
    assert sorted(map(tuple, got.collect())) == brute(as_floats(rows))
    assert "tile" not in names and "m" in names
