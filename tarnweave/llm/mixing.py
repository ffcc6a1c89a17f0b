"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a budget by weight; a source's target stops at ``max_epochs`` times its
size, and what it can't take is shared again among the others. Within a source documents
are counted by exact length. The whole passes of a target come first; the rest of it is
met by an even part of every length, then by larger lengths, then by a bounded-knapsack
dynamic program over the lengths that are left, which finds the reachable sum nearest to
what remains. Texts above ``LONG`` words are settled greedily before, so a very long text costs the
program nothing. The documents of each length are picked in the order of a seeded hash.

Counts are taken by source, length and 256 hash ranges, so a hot source or length is
pre-aggregated and only the one range in which a count ends is ranked.

Defined results: null text has size 0; a null source is a source of its own, last in
order; sizes of 0 take nothing; equal hashes (repeated rows) are interchangeable; an
empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import itertools
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, Scratch

SLICES = 256
#: Texts of more words are settled greedily; the program fits what is left by shorter ones, which bounds its table.
LONG = 1 << 16


def share_budget(sizes: Sequence[float], weights: Sequence[float], budget: float, max_epochs: float = 2) -> list[float]:
    """Targets by weight, none above ``max_epochs`` times its size, the excess shared again by weight."""
    out, open_, left = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s > 0], float(budget)
    while open_:
        total = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / total > max_epochs * sizes[i]]
        if not over:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in over:
            out[i] = float(max_epochs * sizes[i])
        left -= sum(out[i] for i in over)
        open_ = [i for i in open_ if i not in set(over)]
    return out


def _settle_long(lengths: Sequence[int], counts: Sequence[int], budget: int, long: list[int], take: list[int]) -> int:
    """Take of texts above LONG, longest first: the even part of each length, then what texts up to LONG can't fill. Returns the budget that is left to those."""
    sizes = [int(n) * int(c) for n, c in zip(lengths, counts)]
    total, budget = sum(sizes), int(budget)
    short = total - sum(sizes[i] for i in long)
    left = budget
    for i in long:
        take[i] = int(counts[i]) * budget // total
        left -= take[i] * int(lengths[i])
    for i in long:
        n = min(int(counts[i]) - take[i], max(0, -(-(left - short) // int(lengths[i]))), left // int(lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    if left > short:  # the shortest one that is left goes too far, but perhaps less than all is short of it
        more = [i for i in long if take[i] < counts[i]]
        if more and int(lengths[more[-1]]) - left < left - short:
            take[more[-1]] += 1
            left -= int(lengths[more[-1]])
    return max(0, left)


def fit_counts(lengths: Sequence[int], counts: Sequence[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum is as near to ``budget`` as this program gets (the nearest sum for what is left to it)."""
    order = [i for i in range(len(lengths)) if lengths[i] > 0]
    total = sum(int(lengths[i]) * int(counts[i]) for i in order)
    take = [0] * len(lengths)
    if budget >= total:
        for i in order:
            take[i] = int(counts[i])
        return take
    order.sort(key=lambda i: -lengths[i])
    budget = _settle_long(lengths, counts, budget, [i for i in order if lengths[i] > LONG], take)
    order = [i for i in order if lengths[i] <= LONG]
    total = sum(int(lengths[i]) * int(counts[i]) for i in order)
    if budget >= total:
        for i in order:
            take[i] = int(counts[i])
        return take
    top = int(lengths[order[0]]) if order else 0
    even = max(0, int(budget) - 4 * top)  # what is left, some of the longest texts, is the program's to fit
    for i in order:
        take[i] = int(counts[i]) * even // total
    left = int(budget) - sum(take[i] * int(lengths[i]) for i in order)
    for i in order:
        if left < 6 * top:
            break
        n = min(int(counts[i]) - take[i], (left - 4 * top) // int(lengths[i]))
        take[i] += n
        left -= n * int(lengths[i])
    # bounded knapsack: sums reachable with pieces of 1, 2, 4, ... texts of a length; the piece that first reached each
    limit = left + top
    mask = (1 << (limit + 1)) - 1
    reach, pieces, by = 1, [], np.full(limit + 1, -1, np.int64)
    for i in order:
        size, spare, step = int(lengths[i]), int(counts[i]) - take[i], 1
        spare = min(spare, limit // size)
        while spare:
            n = min(step, spare)
            moved = (reach << (n * size)) & mask
            new = moved & ~reach
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(pieces)
                pieces.append((i, n, n * size))
                reach |= new
            spare -= n
            step *= 2
        if reach >> left & 1:
            break
    got = np.flatnonzero(np.unpackbits(np.frombuffer(reach.to_bytes(limit // 8 + 1, "little"), np.uint8), bitorder="little"))
    at = int(got[np.abs(got - left).argmin()])
    while at:
        i, n, size = pieces[by[at]]
        take[i] += n
        at -= size
    return take


def _code_points(name: str | None) -> tuple:
    return (name is None, [ord(c) for c in name or ""])


def mix(
    docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, max_epochs: int = 2, seed: int = 42, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> DataFrame:
    """One row an input row: id, src (its source), tid (hash of the text), size, source_size, target, epochs (times the mix takes it), taken.

    ``weights`` repeat over the sources in code-point order. One row a source reaches the driver.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    tid = F.xxhash64(text)
    rows = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("src"), F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long").alias("size"), tid.alias("tid"), F.xxhash64(F.lit(seed), F.col(id_col), tid).alias("draw")
    ).withColumn("slice", F.pmod("draw", F.lit(SLICES)).cast("int"))
    rows = Scratch(spark, "mix").cut(rows)  # the texts are read once
    cells = rows.groupBy("src", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    found = cells.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("total")).collect()
    found.sort(key=lambda r: _code_points(r[0]))
    sizes = [int(r[1]) for r in found]
    targets = share_budget(sizes, list(itertools.islice(itertools.cycle(weights), len(found))), share * sum(sizes), max_epochs)
    plan = spark.createDataFrame([(r[0], s, float(t)) for r, s, t in zip(found, sizes, targets)], "p_src string, source_size long, target double")

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("size", ignore_index=True)
        whole, target = int(group["source_size"][0]), float(group["target"][0])
        passes = int(target // whole) if whole else 0
        take = fit_counts(group["size"].tolist(), group["n"].tolist(), round(target - passes * whole)) if whole else [0] * len(group)
        return pd.DataFrame({"f_src": group["src"], "f_size": group["size"], "passes": passes, "more": take})

    lengths = cells.groupBy("src", "size").agg(F.sum("n").alias("n"))
    fitted = lengths.join(plan, F.col("src").eqNullSafe(F.col("p_src")), "left").select("src", "size", "n", "source_size", "target")
    fitted = fitted.groupBy("src").applyInPandas(fit, "f_src string, f_size long, passes long, more long")
    upto = Window.partitionBy("src", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ranked = cells.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    quota = ranked.join(fitted, F.col("src").eqNullSafe(F.col("f_src")) & (F.col("size") == F.col("f_size"))).select(
        F.col("src").alias("q_src"), F.col("size").alias("q_size"), F.col("slice").alias("q_slice"), "passes", F.greatest(F.lit(0), F.least("n", F.col("more") - F.col("before"))).alias("quota"), "n"
    )
    met = F.col("src").eqNullSafe(F.col("q_src")) & (F.col("size") == F.col("q_size")) & (F.col("slice") == F.col("q_slice"))
    dealt = rows.join(quota, met).drop("q_src", "q_size", "q_slice")
    inside = (F.col("quota") == F.col("n")) | (F.col("quota") == 0)
    place = F.row_number().over(Window.partitionBy("src", "size", "slice").orderBy("draw", "id"))
    sure = dealt.where(inside).withColumn("plus", (F.col("quota") > 0).cast("long"))
    drawn = dealt.where(~inside).withColumn("plus", (place <= F.col("quota")).cast("long"))
    out = sure.unionByName(drawn)
    return out.join(plan, F.col("src").eqNullSafe(F.col("p_src")), "left").select(
        "id", "src", "tid", "size", "source_size", "target", (F.col("passes") + F.col("plus")).alias("epochs"), ((F.col("passes") + F.col("plus")) * F.col("size")).alias("taken")
    )
