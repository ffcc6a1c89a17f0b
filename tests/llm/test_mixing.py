import itertools
import random
import time

import pytest

from tarnweave.llm.mixing import fit_counts, mix, share_budget


def test_share_budget():
    # one cap, its excess shared again
    assert share_budget([10, 100, 100], [5, 2, 1], 150) == [20, pytest.approx(130 * 2 / 3), pytest.approx(130 / 3)]
    assert sum(share_budget([1, 2, 3], [5, 2, 1], 9)) == pytest.approx(9)
    assert share_budget([0, 4], [5, 2], 6) == [0, 6]
    assert share_budget([], [], 0) == []


def test_fit_counts_is_exact_where_a_sum_exists():
    rng = random.Random(2)
    for _ in range(60):
        lengths = sorted(rng.sample(range(1, 40), 5))
        counts = [rng.randint(1, 3) for _ in lengths]
        sums = {sum(a * b for a, b in zip(c, lengths)) for c in itertools.product(*[range(n + 1) for n in counts])}
        budget = rng.randint(0, max(sums))
        take = fit_counts(lengths, counts, budget)
        assert all(0 <= t <= n for t, n in zip(take, counts))
        assert abs(sum(t * x for t, x in zip(take, lengths)) - budget) == min(abs(x - budget) for x in sums)
    assert fit_counts([3, 5], [10, 10], 41) in ([2, 7], [7, 4])
    assert fit_counts([4], [3], 99) == [3]
    assert fit_counts([], [], 5) == []


def test_very_long_texts():
    """Twenty million words in one text: at once, and what shorter texts can fill is met exactly."""
    began = time.perf_counter()
    for budget in (100, 5_000_000, 20_000_100, 25_000_000, 30_000_000):
        lengths, counts = [*range(1, 501), 20_000_000], [*[200] * 500, 1]
        take = fit_counts(lengths, counts, budget)
        assert sum(t * n for t, n in zip(take, lengths)) == budget and all(t <= c for t, c in zip(take, counts))
    assert time.perf_counter() - began < 10
    assert fit_counts([20_000_000], [1], 9_000_000) == [0] and fit_counts([20_000_000], [1], 11_000_000) == [1]
    assert fit_counts([20_000_000, 5], [3, 2], 41_000_000) == [2, 2]
    # beside small sums where all are tried
    rng = random.Random(3)
    for _ in range(40):
        lengths = sorted(rng.sample(range(60_000, 200_000), 3)) + [1, 7]
        counts = [2, 2, 2, 70_000, 10_000]
        budget = rng.randint(0, sum(a * b for a, b in zip(lengths, counts)))
        take = fit_counts(lengths, counts, budget)
        assert abs(sum(t * n for t, n in zip(take, lengths)) - budget) <= 1


def test_very_long_text_in_a_table(spark):
    rows = [(0, "w " * 300_000, "a")] + [(i, "w " * (i % 50 + 1), "a") for i in range(1, 3000)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), share=1.2).collect()
    assert len(got) == 3000 and abs(sum(r.taken for r in got) - got[0].target) <= 1


def test_mix(spark):
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), "abc"[i % 7 % 3]) for i in range(700)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    assert len(got) == 700 and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    sizes = {s: sum(len(t.split()) for _, t, x in rows if x == s) for s in "abc"}
    want = dict(zip("abc", share_budget(list(sizes.values()), [5, 2, 1], 1.5 * sum(sizes.values()))))
    for s in "abc":
        mine = [r for r in got if r.src == s]
        assert {r.source_size for r in mine} == {sizes[s]} and {r.target for r in mine} == {want[s]}
        assert abs(sum(r.taken for r in mine) - want[s]) <= 1
    again = mix(docs.repartition(7)).collect()
    assert {(r.id, r.taken) for r in again} == {(r.id, r.taken) for r in got}


def test_edges(spark, nasty, nothing):
    got = mix(nasty).collect()
    assert len(got) == nasty.count()
    assert {r.size for r in got if r.id in (1, 2, 3)} == {0}
    assert all(r.taken <= 2 * r.size for r in got)
    assert mix(nothing).count() == 0
