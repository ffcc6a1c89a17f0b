"""Link analysis: degrees, stochastic matrix, sparse mat-vec, dead-end removal, PageRank."""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import Journal, Scratch, dealt

#: Edges of a source beyond which its degree is broadcast.
HUB_DEGREE = 1 << 16
#: Steps of an iteration that are planned as one query before lineage is cut.
STEPS_A_PLAN = 5


def distinct_edges(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def nodes(edges: DataFrame) -> DataFrame:
    """(id) of every source and destination."""
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def out_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def in_degree(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))


def successors(edges: DataFrame, width: int = 1 << 20) -> DataFrame:
    """(id, block, successors) in ascending order; a hub's list comes in blocks of at most ``width`` consecutive ids, so no row outgrows that."""
    block = F.floor(F.col("dst") / width).cast("long")
    return edges.groupBy(F.col("src").alias("id"), block.alias("block")).agg(F.sort_array(F.collect_set("dst")).alias("successors"))


def stochastic_matrix(edges: DataFrame, multi_edges: str = "distinct") -> DataFrame:
    """(row, col, val): column ``src`` spreads 1 over its destinations.

    Parallel edges count once, or with ``multi_edges="weight"`` by their number. Degrees are
    pre-aggregated and joined, those above ``HUB_DEGREE`` by a broadcast, and their edges go through the other join
    by destination, so a hub's edges are never gathered in one place.
    """
    if multi_edges not in ("distinct", "weight"):
        raise ValueError("multi_edges is 'distinct' or 'weight'")
    weighted = edges.groupBy("src", "dst").agg(F.count(F.lit(1)).alias("weight")) if multi_edges == "weight" else distinct_edges(edges).withColumn("weight", F.lit(1))
    weighted = weighted.where("src IS NOT NULL")
    degree = weighted.groupBy("src").agg(F.sum("weight").alias("degree"))
    # a hub has more than HUB_DEGREE edges, so there are few of them
    big = F.broadcast(degree.where(F.col("degree") > HUB_DEGREE).select("src", F.col("degree").alias("big")))
    salted = weighted.join(big, "src", "left").withColumn("salt", F.when(F.col("big").isNull(), F.lit(0).cast("long")).otherwise(F.shiftrightunsigned(F.xxhash64("dst"), 1) + 1))
    # 0, but no constant: the join would be by source alone with one
    both = salted.join(degree.withColumn("salt", F.least("degree", F.lit(0).cast("long"))), ["src", "salt"], "left")
    return both.select(F.col("dst").alias("row"), F.col("src").alias("col"), (F.col("weight") / F.coalesce("big", "degree")).cast("double").alias("val"))


def column_sums(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("col").agg(F.sum("val").alias("total"))


def vector_total(vector: DataFrame) -> DataFrame:
    return vector.agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"))


def matvec_partials(matrix: DataFrame, vector: DataFrame, how: str = "left") -> DataFrame:
    """(row, part) of each cell; a cell without a vector entry gives 0, an entry without cells nothing."""
    v = vector.select(F.col("id").alias("col"), "value")
    return matrix.join(v, "col", how).select("row", (F.col("val") * F.coalesce("value", F.lit(0.0))).alias("part"))


def matvec(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(id, value) of matrix x vector."""
    return matvec_partials(matrix, vector).groupBy(F.col("row").alias("id")).agg(F.sum("part").alias("value"))


@dataclass
class BlockedMatrix:
    """A sparse matrix in two parts, neither of which has a partition that a single row or column fills.

    Cells of ordinary columns are dealt by column, as vectors are by node, so multiplying them shuffles nothing but the
    sums. Columns with more than a set share of all cells are hubs: their cells are dealt evenly by row within the column, and the few
    vector entries they need go to every task. Sums by row are partial in each task first, so hub rows need no part of their own.
    """

    ordinary: DataFrame  # row, col, val
    hubs: DataFrame  # row, col, val
    hub_columns: DataFrame  # col
    n_hubs: int

    def unpersist(self) -> None:
        self.ordinary.unpersist()
        self.hubs.unpersist()


#: A column with more than 1/(HUBS_A_PARTITION * partitions) of all cells is a hub, so there are no more hubs than that product.
HUBS_A_PARTITION = 4
#: Cells of a partition, from which their number grows with the matrix.
CELLS_A_PARTITION = 1 << 21


def blocked(matrix: DataFrame, scratch: Scratch | None = None) -> BlockedMatrix:
    """``matrix`` dealt for many products, hub columns apart. Its size and the hubs are counted."""
    spark = matrix.sparkSession
    scratch = scratch or Scratch(spark, "blocked")
    cells, seen = scratch.cut_counting(matrix.select("row", "col", "val"), n=F.count(F.lit(1)))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-seen["n"] // CELLS_A_PARTITION))
    most = max(1, seen["n"] // (HUBS_A_PARTITION * parts))
    heavy = cells.groupBy("col").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
    heavy, seen = scratch.cut_counting(heavy.select("col"), n=F.count(F.lit(1)))
    hub = F.broadcast(heavy)  # at most HUBS_A_PARTITION columns a partition
    ordinary = dealt(cells.join(hub, "col", "left_anti").select("row", "col", "val"), "col", parts=parts)
    return BlockedMatrix(ordinary, dealt(cells.join(hub, "col", "left_semi").select("row", "col", "val"), "row", "col", parts=parts), heavy, seen["n"])


def blocked_matvec(matrix: BlockedMatrix, vector: DataFrame, few: bool = False) -> DataFrame:
    """(id, value) of matrix x vector, the same rows as ``matvec``; with ``few`` only of rows that an entry of the vector reaches."""
    how = "inner" if few else "left"
    parts = matvec_partials(matrix.ordinary, vector, how)
    if matrix.n_hubs:
        entries = vector.join(F.broadcast(matrix.hub_columns), vector["id"] == matrix.hub_columns["col"], "left_semi")
        v = F.broadcast(entries.select(F.col("id").alias("col"), "value"))
        at_hubs = matrix.hubs.join(v, "col", how).select("row", (F.col("val") * F.coalesce("value", F.lit(0.0))).alias("part"))
        parts = parts.unionByName(at_hubs)
    return parts.groupBy(F.col("row").alias("id")).agg(F.sum("part").alias("value"))


def node_degrees(edges: DataFrame) -> DataFrame:
    """(id, outs, ins, loop) of every node in one aggregate."""
    loop = F.col("src") == F.col("dst")
    ends = F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i"), loop.alias("l")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i"), loop.alias("l"))))
    return edges.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.o").alias("outs"), F.sum("e.i").alias("ins"), F.max("e.l").alias("loop"))


def isolated_self_loops(edges: DataFrame) -> DataFrame:
    """(id) of nodes whose only edge in and out is one to themselves."""
    return node_degrees(edges).where("outs = 1 AND ins = 1 AND loop").select("id")


def surviving_nodes(edges: DataFrame) -> DataFrame:
    """(id) with a successor, without isolated self-loops."""
    return node_degrees(edges).where("outs > 0 AND NOT (outs = 1 AND ins = 1 AND loop)").select("id")


def deadend_pass(edges: DataFrame) -> DataFrame:
    """Edges whose destination survives."""
    return edges.join(surviving_nodes(edges).withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


@dataclass
class Peeled:
    edges: DataFrame
    n_nodes: int
    passes: list[tuple[int, int, int]] = field(default_factory=list)  # pass, nodes, edges


#: Directories that edges are dealt to by destination, so that a pass reads only those of the nodes that just died.
PARTS = 16
#: Passes whose logs are read one by one before they are merged; dead nodes that may be broadcast.
LOGS, SMALL = 8, 100_000


def _dead(left: Column, ins: Column, loop: Column) -> Column:
    """No successor left, or none but itself and no other predecessor."""
    return (left == 0) | ((left == 1) & (ins == 1) & loop)


def remove_deadends(edges: DataFrame, scratch: Scratch | None = None, multi_edges: str = "distinct", journal: Journal | None = None, saved: dict | None = None, max_passes: int | None = None) -> Peeled:
    """Passes until the number of surviving nodes no longer changes, by a worklist.

    Degrees are counted once and stand beside each edge's source. A pass joins the edges into the nodes
    that died in the last one, counts what their sources lose, and writes these sources alone: whoever has no
    successor left (or only an isolated loop) is the next worklist. In-degrees of survivors never change,
    since a dying node has no edge but one to itself. All numbers of a pass come from its write, and each
    edge is touched once in all passes. With a ``journal`` every pass is committed, and ``saved`` is its last entry;
    ``max_passes`` breaks off earlier.
    """
    spark = edges.sparkSession
    scratch = scratch or Scratch(spark, "peel")
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)).cast("int")
    parts_of = lambda dead: F.array_compact(F.collect_set(F.when(dead, F.col("part"))))
    if saved is None:
        given, seen = scratch.cut_counting(distinct_edges(edges) if multi_edges == "distinct" else edges.select("src", "dst"), n=F.count(F.lit(1)))
        n_edges = seen["n"]
        degrees = node_degrees(given).withColumn("dead", _dead(F.col("outs"), F.col("ins"), F.col("loop"))).withColumn("part", part("id"))
        degrees, seen = scratch.cut_counting(degrees, n=F.count(F.lit(1)), dead=F.count_if("dead"), parts=parts_of(F.col("dead")))
        beside = given.join(degrees.select(F.col("id").alias("src"), "outs", "ins", "loop"), "src").withColumn("part", part("dst"))
        beside = scratch.cut(beside, partition_by="part") if seen["dead"] else given
        n_nodes, n_dead, parts, states, logs, passes = seen["n"], seen["dead"], list(seen["parts"]), [degrees], [], []
    else:
        scratch.n = saved["n"]
        given, beside, states, logs = (scratch.read(p) if isinstance(p, str) else [scratch.read(x) for x in p] for p in (saved["given"], saved["beside"], saved["states"], saved["logs"]))
        n_edges, n_nodes, n_dead, parts, passes = saved["n_edges"], saved["n_nodes"], saved["n_dead"], saved["parts"], [tuple(p) for p in saved["passes"]]
    while max_passes is None or len(passes) < max_passes:
        n_nodes -= n_dead
        if not n_dead:
            passes.append((len(passes) + 1, n_nodes, n_edges))
            break
        key = states[-1].where("dead").select(F.col("id").alias("dst"))
        hit = beside.where(F.col("part").isin(parts)).join(F.broadcast(key) if n_dead <= SMALL else key, "dst")
        # what sources lose now and what they have lost before meet in one aggregate
        now = hit.select(F.col("src").alias("id"), F.lit(1).alias("lost"), F.lit(0).cast("long").alias("gone"), "outs", "ins", "loop", (F.col("src") == F.col("dst")).alias("own"))
        for x in logs:
            now = now.unionByName(x.select("id", F.lit(0).alias("lost"), "gone"), allowMissingColumns=True)
        lost = now.groupBy("id").agg(F.sum("lost").alias("lost"), F.max("gone").alias("gone"), *[F.max(c).alias(c) for c in ("outs", "ins", "loop", "own")]).where("lost > 0").withColumn("gone", F.col("gone") + F.col("lost"))
        # an isolated loop has been buried already
        state = lost.withColumn("dead", _dead(F.col("outs") - F.col("gone"), F.col("ins"), F.col("loop")) & ~F.col("own")).withColumn("part", part("id"))
        state, seen = scratch.cut_counting(state, ["id", "gone", "dead"], lost=F.coalesce(F.sum("lost"), F.lit(0)), dead=F.count_if("dead"), parts=parts_of(F.col("dead")))
        n_edges, n_dead, parts = n_edges - seen["lost"], seen["dead"], list(seen["parts"])
        passes.append((len(passes) + 1, n_nodes, n_edges))
        states.append(state)
        logs.append(state)
        if len(logs) > LOGS:
            logs = [scratch.cut(functools.reduce(DataFrame.unionByName, [x.select("id", "gone") for x in logs]).groupBy("id").agg(F.max("gone").alias("gone")))]
        if journal is not None:
            path = lambda df: df._scratch_path
            journal.commit({
                "n": scratch.n, "given": path(given), "beside": path(beside), "states": [*map(path, states)], "logs": [*map(path, logs)], "n_edges": n_edges, "n_nodes": n_nodes, "n_dead": n_dead, "parts": parts, "passes": passes,
            })
    if len(passes) == 1:
        return Peeled(given, n_nodes, passes)
    gone = functools.reduce(DataFrame.unionByName, [x.where("dead").select(F.col("id").alias("dst")) for x in states])
    return Peeled(scratch.cut(given.join(gone, "dst", "left_anti").select("src", "dst")), n_nodes, passes)


def initial_vector(ids: DataFrame, n: int | None = None) -> DataFrame:
    """(id, value) with 1/n everywhere."""
    n = ids.count() if n is None else n
    return ids.select("id", F.lit(1.0 / n if n else None).cast("double").alias("value"))


def teleport(product: DataFrame, ids: DataFrame, beta: float = 0.8, n: int | None = None) -> DataFrame:
    """beta * value + (1 - beta) / n for every node; one without in-links has the second part alone."""
    n = ids.count() if n is None else n
    joined = ids.select("id").join(product.select("id", "value"), "id", "left")
    return joined.select("id", (F.lit(beta) * F.coalesce("value", F.lit(0.0)) + F.lit((1 - beta) / max(n, 1))).alias("value"))


def l1_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.select("id", F.col("value").alias("x")).join(b.select("id", F.col("value").alias("y")), "id", "full")
    return both.agg(F.coalesce(F.sum(F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))), F.lit(0.0)).alias("distance"))


def converged(a: DataFrame, b: DataFrame, epsilon: float) -> bool:
    return l1_distance(a, b).first()[0] < epsilon


@dataclass
class Ranked:
    ranks: DataFrame
    steps: int
    trace: list[tuple[int, float]]  # step, L1 change; from the second step on
    peeled: Peeled


def pagerank(edges: DataFrame, beta: float = 0.8, epsilon: float | None = 0.1, max_iter: int = 100, multi_edges: str = "distinct", run: str | None = None, finish: bool = True) -> Ranked:
    """Dead ends removed, then power steps with teleport.

    The change is checked from the second step on, strictly below ``epsilon``. With
    ``epsilon=None`` exactly ``max_iter`` steps run, several to a plan.

    With a name of the ``run`` each pass and each written step is committed to a journal. A call with the same name
    goes on behind the last complete one and reads no table of those before; all but the result is deleted at the end, unless ``finish`` is false.
    """
    spark = edges.sparkSession
    journal = Journal(spark, run) if run else None
    saved = (journal.load() if journal else None) or {}
    scratch = Scratch(spark, "pagerank", journal.base if journal else None)
    scratch.n = saved.get("n", 0)
    if "peeled" in saved:
        peeled = Peeled(scratch.read(saved["peeled"]), saved["n_nodes"], [tuple(p) for p in saved["passes"]])
    else:
        peeled = remove_deadends(edges, scratch, multi_edges, journal, saved or None)
    n = peeled.n_nodes
    # both sides of every step's joins stay dealt by node: a step shuffles its pre-aggregated products alone
    ids = dealt(scratch.cut(nodes(peeled.edges)), "id")
    matrix = blocked(stochastic_matrix(peeled.edges, multi_edges), scratch)
    trace, steps = [tuple(t) for t in saved.get("trace", [])], saved.get("steps", 0)
    written = scratch.read(saved["ranks"]) if "ranks" in saved else None
    now = initial_vector(ids, n) if written is None else written
    done = bool(trace) and epsilon is not None and trace[-1][1] < epsilon

    def commit() -> None:
        if journal is not None:
            journal.commit({"n": scratch.n, "peeled": peeled.edges._scratch_path, "n_nodes": n, "passes": peeled.passes, "ranks": written._scratch_path, "steps": steps, "trace": trace})

    while steps < max_iter and n and not done:
        after = teleport(blocked_matvec(matrix, now), ids, beta, n)
        steps += 1
        if epsilon is None:
            if steps % STEPS_A_PLAN == 0 and steps < max_iter:
                old, after = written, scratch.cut(after)
                written = after
                commit()
                if old is not None:
                    scratch.drop(old)
            now = after
            continue
        # the step's change is taken in the same pass that writes it
        both = after.join(now.select("id", F.col("value").alias("old")), "id")
        after, seen = scratch.cut_counting(both, ["id", "value"], change=F.sum(F.abs(F.col("value") - F.col("old"))))
        old, written, now = written, after, after
        if steps >= 2:
            trace.append((steps, seen["change"]))
            done = seen["change"] < epsilon
        commit()
        if old is not None:
            scratch.drop(old)
    now = now if now is written else scratch.cut(now)
    ids.unpersist()
    matrix.unpersist()
    if journal is not None and finish:
        journal.finish(now, peeled.edges)
    return Ranked(now, steps, trace, peeled)


@dataclass
class Pushed:
    ranks: DataFrame  # id, value
    bound: float  # on the L1 distance to the exact ranks
    steps: int
    active: list[int]  # nodes that sent at each step


def pagerank_push(edges: DataFrame, beta: float = 0.8, rest: float = 0.02, max_iter: int = 1000, multi_edges: str = "distinct") -> Pushed:
    """PageRank of the peeled graph by residuals: only nodes that still owe more than ``rest`` / n send.

    A node's state is its rank and its residual, what it has received and not passed on; at first the teleport share.
    A sender adds its residual to its rank and gives ``beta`` of it to its successors. The exact ranks exceed the ranks, all residuals
    included, by at most beta / (1 - beta) times the residuals' sum, which is the bound that is returned; it is below rest * beta / (1 - beta).
    A step's rows are the senders' cells; its counts come from the write.
    """
    scratch = Scratch(edges.sparkSession, "push")
    peeled = remove_deadends(edges, scratch, multi_edges)
    n = peeled.n_nodes
    if not n:
        return Pushed(initial_vector(nodes(peeled.edges), 0), 0.0, 0, [])
    matrix = blocked(stochastic_matrix(peeled.edges, multi_edges), scratch)
    least = rest / n
    start = nodes(peeled.edges).select("id", F.lit(0.0).alias("rank"), F.lit((1 - beta) / n).alias("residual"))
    counts = {"owed": F.sum("residual"), "active": F.count_if(F.col("residual") > least)}
    state, seen = scratch.cut_counting(start, **counts)
    active = []
    while seen["active"] and len(active) < max_iter:
        active.append(seen["active"])
        sends = F.col("residual") > least
        sent = state.where(sends).select("id", F.col("residual").alias("value"))
        got = blocked_matvec(matrix, sent, few=True)
        after = state.join(got.withColumnRenamed("value", "got"), "id", "left").select(
            "id", (F.col("rank") + F.when(sends, F.col("residual")).otherwise(0.0)).alias("rank"),
            (F.when(sends, 0.0).otherwise(F.col("residual")) + F.lit(beta) * F.coalesce("got", F.lit(0.0))).alias("residual"),
        )
        after, seen = scratch.cut_counting(after, **counts)
        scratch.drop(state)
        state = after
    matrix.unpersist()
    return Pushed(state.select("id", (F.col("rank") + F.col("residual")).alias("value")), seen["owed"] * beta / (1 - beta), len(active), active)


def top_ranks(ranks: DataFrame, k: int = 10) -> DataFrame:
    return ranks.orderBy(F.desc("value"), "id").limit(k)
