import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from tarnweave.operators import graph as G

G1 = [(3, 1), (4, 1), (1, 2), (2, 2), (3, 2), (4, 3), (1, 3), (1, 4), (3, 4)]
CELLS = [(1, 1, 0.5), (1, 2, 0.5), (2, 3, 0.5), (2, 4, 0.5), (3, 1, 0.5), (3, 2, 0.5), (4, 2, 0.5), (4, 3, 0.5)]
G3 = [(1, 2), (2, 3), (2, 6), (3, 4), (4, 5), (5, 4), (6, 4), (6, 7), (7, 8), (8, 9), (7, 1)]


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def as_dict(df):
    return {r[0]: r[1] for r in df.collect()}


def test_stochastic_matrix(spark):
    m = G.stochastic_matrix(edges(spark, G1))
    third = pytest.approx(1 / 3)
    cells = {(r.row, r.col): r.val for r in m.collect()}
    assert cells == {(2, 1): third, (3, 1): third, (4, 1): third, (2, 2): 1, (1, 3): third, (2, 3): third, (4, 3): third, (1, 4): 0.5, (3, 4): 0.5}
    assert all(abs(v - 1) < 1e-3 for v in as_dict(G.column_sums(m)).values())


def test_parallel_edges(spark):
    e = edges(spark, [(1, 2), (1, 2), (1, 3)])
    assert as_set(G.stochastic_matrix(e)) == {(2, 1, 0.5), (3, 1, 0.5)}
    assert {(r.row, round(r.val, 6)) for r in G.stochastic_matrix(e, "weight").collect()} == {(2, 0.666667), (3, 0.333333)}
    with pytest.raises(ValueError):
        G.stochastic_matrix(e, "other")


def test_matvec(spark):
    m = spark.createDataFrame(CELLS, "row long, col long, val double")
    v = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, 0.3), (4, 0.4)], "id long, value double")
    got = as_dict(G.matvec(m, v))
    assert got == {1: pytest.approx(0.15), 2: pytest.approx(0.35), 3: pytest.approx(0.15), 4: pytest.approx(0.25)}
    total = G.vector_total(G.matvec(m, v)).first()
    assert abs(total.total - 0.9) < 1e-3 and total.n == 4


def test_matvec_missing_entries(spark):
    m = spark.createDataFrame([(1, 1, 0.5), (2, 9, 1.0)], "row long, col long, val double")
    v = spark.createDataFrame([(1, 1.0), (5, 7.0)], "id long, value double")
    assert as_dict(G.matvec(m, v)) == {1: 0.5, 2: 0.0}


def test_remove_deadends(spark):
    peeled = G.remove_deadends(edges(spark, G3))
    assert peeled.passes == [(1, 8, 10), (2, 7, 9), (3, 7, 9)]
    assert peeled.n_nodes == 7
    assert as_set(peeled.edges) == {(1, 2), (2, 3), (2, 6), (3, 4), (4, 5), (5, 4), (6, 4), (6, 7), (7, 1)}


def test_self_loops_and_paths(spark):
    assert as_set(G.remove_deadends(edges(spark, [(1, 1), (2, 3), (3, 2)])).edges) == {(2, 3), (3, 2)}
    assert as_set(G.remove_deadends(edges(spark, [(1, 2), (2, 2)])).edges) == {(1, 2), (2, 2)}
    assert as_set(G.isolated_self_loops(edges(spark, [(1, 1), (2, 2), (1, 2)]))) == set()
    peeled = G.remove_deadends(edges(spark, [(1, 2), (2, 3)]))
    assert peeled.n_nodes == 0 and peeled.edges.count() == 0
    assert len(G.remove_deadends(edges(spark, [(1, 2), (2, 1)])).passes) == 1
    assert G.remove_deadends(edges(spark, [])).n_nodes == 0


def slow_peel(pairs):
    """Passes by definition, over all edges each time."""
    now, before, passes = list(pairs), len({x for e in pairs for x in e}), []
    while True:
        outs, ins = Counter(a for a, _ in now), Counter(b for _, b in now)
        alive = {x for x in outs if not (outs[x] == 1 and ins[x] == 1 and (x, x) in now)}
        now = [e for e in now if e[1] in alive]
        passes.append((len(passes) + 1, len(alive), len(now)))
        if len(alive) == before:
            return sorted(now), passes
        before = len(alive)


@pytest.mark.parametrize("multi_edges", ["distinct", "weight"])
def test_worklist_against_all_edges(spark, multi_edges):
    """Chains longer than the logs that are kept apart, loops that end up alone, doubled loops and parallel edges."""
    rng = random.Random(4)
    pairs = [(i, i + 1) for i in range(100, 114)] + [(7, 7), (7, 100), (8, 8), (8, 8), (8, 101), (9, 9), (300, 301), (301, 301), (100, 500), (500, 501), (501, 500)]
    pairs += [(rng.randrange(60), rng.randrange(60)) for _ in range(75)]
    given = sorted(set(pairs)) if multi_edges == "distinct" else pairs
    want, passes = slow_peel(given)
    peeled = G.remove_deadends(edges(spark, pairs), multi_edges=multi_edges)
    assert peeled.passes == passes and peeled.n_nodes == passes[-1][1] and len(passes) > 12
    assert sorted((r.src, r.dst) for r in peeled.edges.collect()) == want


def test_one_job_a_pass(spark, monkeypatch):
    """Counts come from the writes, and only edges into dead nodes are joined."""
    from tarnweave.plans.lineage import Scratch

    writes, read = [], []
    cut = Scratch.cut
    monkeypatch.setattr(Scratch, "cut", lambda self, df, *a, **b: writes.append(1) or cut(self, df, *a, **b))
    monkeypatch.setattr(DataFrame, "count", lambda self: read.append(1))
    monkeypatch.setattr(DataFrame, "first", lambda self: read.append(1))
    monkeypatch.setattr(DataFrame, "collect", lambda self: read.append(1))
    peeled = G.remove_deadends(edges(spark, [(i, i + 1) for i in range(6)] + [(10, 11), (11, 10), (3, 10)]))
    assert len(peeled.passes) == 4 and len(writes) == 3 + 3 + 1 and not read


def test_resumes_after_a_lost_driver(spark, monkeypatch):
    """Broken off in the fourth step and in the third peel pass: the next call goes on from there, reads no earlier step, and leaves the result alone."""
    import os
    import uuid

    from tarnweave.plans.lineage import Journal, Scratch, checkpoint_dir

    chain = G3 + [(9, 20), (20, 21), (21, 22), (22, 23), (23, 24)]
    whole = G.pagerank(edges(spark, chain), 0.8, 1e-3)
    cut, left, run, written = Scratch.cut, [], uuid.uuid4().hex, []

    def failing(self, df, *a, **b):
        if len(left) == 1 and left[0] == 0:
            left.clear()
            raise RuntimeError("the driver is lost")
        if left:
            left[0] -= 1
        written.append(self.n)
        return cut(self, df, *a, **b)

    monkeypatch.setattr(Scratch, "cut", failing)
    for after in (5, 12):  # three tables and two passes; the rest of the passes, the matrix and some steps
        left.append(after)
        with pytest.raises(RuntimeError):
            G.pagerank(edges(spark, chain), 0.8, 1e-3, run=run)
    folder = f"{checkpoint_dir(spark)}/run-{run}".removeprefix("file:")
    saved = Journal(spark, run).load()
    assert saved["steps"] >= 3 and len(saved["passes"]) == len(whole.peeled.passes) and os.path.isdir(saved["ranks"].removeprefix("file:"))
    read, at = [], Scratch.read
    monkeypatch.setattr(Scratch, "read", lambda self, path, *a: (read.append(path) if not a else None) or at(self, path, *a))
    before = len(written)
    again = G.pagerank(edges(spark, chain), 0.8, 1e-3, run=run)
    assert read == [saved["peeled"], saved["ranks"]] and again.steps == whole.steps and again.peeled.passes == whole.peeled.passes
    assert len(written) - before == whole.steps - saved["steps"] + 3 and [k for k, _ in again.trace] == [k for k, _ in whole.trace]
    assert as_dict(again.ranks) == {k: pytest.approx(v) for k, v in as_dict(whole.ranks).items()}
    assert sorted(os.listdir(folder)) == sorted(x._scratch_path.rsplit("/", 1)[1] for x in (again.ranks, again.peeled.edges))


def test_hub_columns_and_rows(spark):
    """A node with nine tenths of the edges: even partitions, and the same product."""
    rng = random.Random(3)
    pairs = {(0, d) for d in range(1, 9001)} | {(rng.randrange(1, 400), rng.randrange(1, 9001)) for _ in range(800)} | {(s, 0) for s in range(1, 200)}
    e = edges(spark, sorted(pairs))
    matrix = G.stochastic_matrix(e)
    b = G.blocked(matrix)
    assert b.n_hubs == 1 and [r.col for r in b.hub_columns.collect()] == [0]
    for part in (b.hubs, b.ordinary):
        sizes = [r["count"] for r in part.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) <= 4 * statistics.median(sizes) and len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = G.nodes(e).where("id % 7 <> 0").select("id", (F.col("id") % 5 + 0.5).alias("value"))
    assert as_dict(G.blocked_matvec(b, v)) == {k: pytest.approx(x) for k, x in as_dict(G.matvec(matrix, v)).items()}
    without = G.blocked(G.stochastic_matrix(edges(spark, [(a, (a * 7 + 1) % 50) for a in range(50)])))
    assert without.n_hubs == 0 and G.blocked_matvec(without, v).count() == 50
    assert G.blocked_matvec(G.blocked(G.stochastic_matrix(edges(spark, []))), v).count() == 0


def test_push(spark):
    """Ranks within the bound of the exact ones, and fewer senders each time."""
    pushed = G.pagerank_push(edges(spark, G3), 0.8, 0.02)
    got, exact = as_dict(pushed.ranks), dict(zip(range(1, 8), [0.071556, 0.085816, 0.062898, 0.352517, 0.310585, 0.062898, 0.053731]))
    assert sum(abs(got[k] - exact[k]) for k in exact) <= pushed.bound + 7e-6 and pushed.bound < 0.08
    assert pushed.active[0] == 7 and pushed.active[-1] < 7 and pushed.steps == len(pushed.active)
    assert G.pagerank_push(edges(spark, [(1, 2)])).ranks.count() == 0


@pytest.mark.parametrize("epsilon, steps, want", [
    (0.1, 6, [0.074176, 0.091657, 0.065234, 0.329097, 0.319936, 0.065234, 0.054665]),
    (1e-3, 26, [0.071556, 0.085816, 0.062898, 0.352325, 0.310777, 0.062898, 0.053731]),
])
def test_pagerank(spark, epsilon, steps, want):
    ranked = G.pagerank(edges(spark, G3), 0.8, epsilon)
    got = as_dict(ranked.ranks)
    assert ranked.steps == steps
    assert [got[k] for k in range(1, 8)] == [pytest.approx(x, abs=1.5e-6) for x in want]
    assert abs(sum(got.values()) - 1) < 1e-9
    assert [round(c, 5) for _, c in ranked.trace[:5]] == [0.27429, 0.21943, 0.17554, 0.10533, 0.08426]
    assert ranked.trace[0][0] == 2


def test_pagerank_fixed_steps_agree(spark):
    a, b = as_dict(G.pagerank(edges(spark, G3), 0.8, None, 6).ranks), as_dict(G.pagerank(edges(spark, G3), 0.8, 0.1).ranks)
    assert a == {k: pytest.approx(v, abs=1e-12) for k, v in b.items()}


def test_ids_with_gaps_and_sources(spark):
    e = edges(spark, [(10, 500), (500, 7), (7, 500)])
    got = as_dict(G.pagerank(e, 0.8, None, 20).ranks)
    assert got[10] == pytest.approx(0.2 / 3)  # no in-links
    assert sum(got.values()) == pytest.approx(1)
    assert [r.id for r in G.top_ranks(G.pagerank(e, 0.8, None, 20).ranks, 2).collect()] == [500, 7]
    assert G.pagerank(edges(spark, [])).ranks.count() == 0


def test_convergence(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.5)], "id long, value double")
    b = spark.createDataFrame([(2, 0.45), (1, 0.55)], "id long, value double")
    assert G.converged(a, b, 0.11) and not G.converged(a, b, 0.1 - 1e-9)


def test_rank_command_line(spark, tmp_path):
    from tarnweave import rank_cli

    (tmp_path / "a").write_text("1 2\n2 1\n2 3\n")
    (tmp_path / "b").write_text("3 1\n\nbad line here\n1 9\n")
    report = rank_cli.main([str(tmp_path / "a"), str(tmp_path / "b"), "--output", str(tmp_path / "out"), "--epsilon", "1e-6"], spark)
    ranks = dict(line.split("\t") for f in (tmp_path / "out").glob("part-*") for line in f.read_text().splitlines())
    assert set(ranks) == {"1", "2", "3"} and report["nodes"] == 3
    assert sum(map(float, ranks.values())) == pytest.approx(1, abs=1e-6)


def test_successor_blocks(spark):
    edges = spark.createDataFrame([(1, d) for d in range(10)] + [(2, 5)], "src long, dst long")
    got = {(r.id, r.block): r.successors for r in G.successors(edges, 4).collect()}
    assert got == {(1, 0): [0, 1, 2, 3], (1, 1): [4, 5, 6, 7], (1, 2): [8, 9], (2, 1): [5]}


def test_hub_edges_are_dealt_by_destination(spark, monkeypatch):
    """A hub's edges meet its degree in many partitions; values, null sources included, stay those of a plain join."""
    monkeypatch.setattr(G, "HUB_DEGREE", 100)
    rows = [(-1, i) for i in range(2000)] + [(i, i % 7) for i in range(300)] + [(i, 500) for i in range(50)] + [(None, 3)]
    edges = spark.createDataFrame(rows, "src long, dst long")
    matrix = G.stochastic_matrix(edges)
    plain = {(d, s): 1 / (2000 if s == -1 else 2 if s < 50 else 1) for s, d in rows if s is not None}
    assert {(r.row, r.col): r.val for r in matrix.collect()} == plain
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        many = [r.n for r in G.stochastic_matrix(edges).withColumn("p", F.spark_partition_id()).where(F.col("col") + 0 * F.rand() < 0).groupBy("p").agg(F.count("row").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert max(many) < 1000 and sum(many) == 2000
