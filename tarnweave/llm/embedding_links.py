"""Near-duplicate vectors by counting collisions of one-dimensional projections.

Vectors that are equal up to length are one class. Classes are projected on many directions, of
which only the far ends are kept: there strangers are rare and vectors at the wanted angle still
meet with a chance near one half. A direction's ends are sorted, each entry opens a window around
itself, and the collisions of every pair are counted over all directions. Pairs with a count that
pairs exactly at the threshold reach with the wanted recall (found by simulation with the same
directions) are verified in double precision. The number of directions grows with the rows, so that
an end keeps the same few strangers; directions are sums of two half-length ones, so a vector finds
its ends among them without visiting all.

Groups of copies come first: vectors within half the angle of a leader form a ball, inside which
all pairs are links and none is listed. Collisions are counted by ball; two balls are settled as a
whole where their centres and radii allow it, and else by products of bounded packs of their members,
which count links and list none.

Defined results: vectors that are null, empty or zero or hold null or non-finite components link with
nothing (0 links, a component of their own); a shorter vector counts as filled up with zeros; repeated
rows link with each other; a row without identifier takes part, but names no component unless all of
its rows have none; ties need no rule, as the threshold is inclusive; an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, dense, small_batches, splitmix, widest
from .components import connected

#: Entries of strangers at an end of a direction; collisions that a pair at the threshold has on average; tables of directions.
CROWD, EXPECTED, TABLES = 5, 20, 32
#: Rounds of ball building, leaders of a cell, members of a pack.
ROUNDS, LEADERS, PACK = 3, 4, 256
#: Angles are compared with this much room, so that rounding can't settle a pair wrongly.
ROOM = 1e-7


def _matrix(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def unit_rows(df: DataFrame, id_col: str, vector_col: str, width: int) -> DataFrame:
    """(id, x): x is the vector scaled to length 1, as bytes of ``width`` doubles; null for vectors that link with nothing."""
    small_batches(df.sparkSession)
    schema = df.select(F.col(id_col).alias("id")).schema.add("x", "binary")

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, ok = dense(b.column(1), width)
            most = np.abs(x).max(1)
            ok &= most > 0
            x = x / np.where(ok, most, 1)[:, None]  # first by the largest, so that no square overflows
            x = x / np.where(ok, np.sqrt((x * x).sum(1)), 1)[:, None] + 0.0  # no negative zeros
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() if k else None for v, k in zip(x, ok)], pa.binary())], names=["id", "x"])

    return df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vec")).mapInArrow(run, schema)


def _cells(free: DataFrame, width: int, hashes: int, seed: int) -> DataFrame:
    """(uid, x, cell): the cell is the nearest axis after a random rotation, ``hashes`` times."""

    def run(batches: Iterator[pa.RecordBatch]):
        g = np.random.default_rng(seed).standard_normal((hashes, width, width))
        for b in batches:
            x, cell = _matrix(b.column(1), width), np.full(b.num_rows, seed, np.uint64)
            for h in g:
                y = x @ h
                axis = np.abs(y).argmax(1)
                cell = splitmix(cell * np.uint64(0x9E3779B97F4A7C15) + (2 * axis + (y[np.arange(len(y)), axis] > 0)).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell.view(np.int64))], names=["uid", "x", "cell"])

    return free.select("uid", "x").mapInArrow(run, "uid long, x binary, cell long")


def _join_leaders(met: DataFrame, width: int, least: float) -> DataFrame:
    """(uid, x, ball, c): the first leader with a cosine of ``least`` or more, and that cosine; leaders stay free."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            leaders = b.column(2)
            x, uid = _matrix(b.column(1), width), b.column(0).to_numpy()
            size = np.diff(leaders.offsets.to_numpy())
            flat = leaders.flatten()
            who, row = flat.field("uid").to_numpy(), np.repeat(np.arange(len(uid)), size)
            c = np.einsum("ij,ij->i", x[row], _matrix(flat.field("x"), width)) if len(row) else np.zeros(0)
            is_leader = np.zeros(len(uid), bool)
            is_leader[row[who == uid[row]]] = True
            good = np.flatnonzero((c >= least) & ~is_leader[row])
            ball, at = np.full(len(uid), -1, np.int64), np.ones(len(uid))
            ball[row[good[::-1]]], at[row[good[::-1]]] = who[good[::-1]], c[good[::-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(ball, mask=ball < 0), pa.array(np.minimum(at, 1))], names=["uid", "x", "ball", "c"])

    return met.select("uid", "x", "leaders").mapInArrow(run, "uid long, x binary, ball long, c double")


def build_balls(classes: DataFrame, width: int, threshold: float, n: int, scratch: Scratch, seed: int) -> DataFrame:
    """(uid, x, ball, c) of every class: a ball's members are within half the angle of its centre, the class whose uid it bears."""
    half = math.cos(math.acos(threshold) / 2) + ROOM
    hashes = max(1, math.ceil((math.log2(max(n, 2)) - 3) / math.log2(2 * width)))
    free, settled = classes.select("uid", "x"), None
    for r in range(ROUNDS):
        cells = scratch.cut(_cells(free, width, hashes, seed + r))
        order = F.xxhash64("uid", F.lit(seed + r))
        slots = cells.groupBy("cell", F.pmod(order, F.lit(LEADERS)).alias("slot")).agg(F.min_by(F.struct("uid", "x"), order).alias("l"), F.count(F.lit(1)).alias("n"))
        leaders = slots.groupBy("cell").agg(F.collect_list("l").alias("leaders"), F.sum("n").alias("n")).where("n > 1").drop("n")
        met = cells.join(leaders, "cell", "left").withColumn("leaders", F.coalesce("leaders", F.array().cast("array<struct<uid:bigint,x:binary>>")))
        after = scratch.cut(_join_leaders(met, width, half))
        joined = after.where("ball IS NOT NULL")
        settled = joined if settled is None else settled.unionByName(joined)
        free = after.where("ball IS NULL").select("uid", "x")
    return scratch.cut(settled.unionByName(free.select("uid", "x", F.col("uid").alias("ball"), F.lit(1.0).alias("c"))))


class Directions:
    """Tables of directions g + h over the two halves of a rotated space, all signs; their ends begin at ``tail``."""

    def __init__(self, width: int, n: int, threshold: float, seed: int, crowd: int = CROWD, expected: float = EXPECTED, tables: int = TABLES):
        q = min(0.05, crowd / max(n, 1))
        self.tail = NormalDist().inv_cdf(1 - q)
        # a partner's chance of being at the same end, taken where the end's mean is
        at = self.tail + 1 / (self.tail + 1 / self.tail)
        meets = 1 - NormalDist().cdf((self.tail - threshold * at) / math.sqrt(1 - threshold**2))
        self.half = max(3, math.ceil(math.sqrt(expected / (q * meets) / tables) / 2))
        self.window = 3 * math.sqrt(2 - 2 * threshold)  # three deviations of the difference of two projections
        self.width, self.tables, self.seed = width, tables, seed
        self.codes = self._drawn()

    def _drawn(self) -> list:
        rng, out = np.random.default_rng(self.seed), []
        for _ in range(self.tables):
            turn = np.linalg.qr(rng.standard_normal((self.width, self.width)))[0]
            halves = turn[:, : self.width // 2], turn[:, self.width // 2 :]
            out.append([h @ rng.standard_normal((h.shape[1], self.half)) for h in halves])
        return out

    def __getstate__(self) -> dict:
        """Tasks draw the codes again from the seed: they grow with the root of the rows, and needn't travel."""
        return {k: v for k, v in self.__dict__.items() if k != "codes"}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.codes = self._drawn()

    def ends(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, direction, value) of all projections beyond ``tail``."""
        out, n = [], 2 * self.half
        for t, codes in enumerate(self.codes):
            left, right = (np.concatenate((p := x @ c, -p), 1) for c in codes)
            # only what reaches the tail with the other half's best can be part of an end
            r1, i = np.nonzero(left >= self.tail - right.max(1, keepdims=True))
            r2, j = np.nonzero(right >= self.tail - left.max(1, keepdims=True))
            many = np.bincount(r2, minlength=len(x))
            first, reps = np.cumsum(many) - many, many[r1]
            other = np.repeat(first[r1], reps) + np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
            row, i, j = np.repeat(r1, reps), np.repeat(i, reps), j[other]
            value = left[row, i] + right[row, j]
            end = value >= self.tail
            out.append((row[end], (t * n + i[end]) * n + j[end], value[end]))
        return tuple(np.concatenate(c) for c in zip(*out))

    def calibrate(self, threshold: float, width: int, recall: float, pairs: int = 4000, seed: int = 5) -> int:
        """The greatest count that a share ``recall`` of random pairs exactly at the threshold reach."""
        rng = np.random.default_rng(seed)
        x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, pairs, width)))
        y = y - (x * y).sum(1, keepdims=True) * x
        y = threshold * x + math.sqrt(1 - threshold**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        counts = np.zeros(pairs, np.int64)
        for at in range(0, pairs, 256):
            (r1, d1, v1), (r2, d2, v2) = self.ends(x[at : at + 256]), self.ends(y[at : at + 256])
            size = np.int64(len(self.codes) * 4 * self.half**2)
            _, i, j = np.intersect1d(r1 * size + d1, r2 * size + d2, assume_unique=True, return_indices=True)
            counts[at : at + 256] = np.bincount(r1[i][np.abs(v1[i] - v2[j]) <= self.window], minlength=len(x[at : at + 256]))
        return int(np.sort(counts)[int((1 - recall) * pairs)])


def calibrated(width: int, n: int, threshold: float, recall: float, seed: int) -> tuple[Directions, int]:
    """Directions for ``n`` classes, as many as it takes for a count of 2 at least to have the recall, and that count."""
    expected = EXPECTED
    while True:
        directions = Directions(width, n, threshold, seed, expected=expected)
        if (enough := directions.calibrate(threshold, width, recall)) >= 2:
            return directions, enough
        expected *= 1.5


def projected(balls: DataFrame, width: int, directions: Directions) -> DataFrame:
    """(direction, ball, low, high): where the members of a ball stand on each direction at whose end they are."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, ball = _matrix(b.column(1), width), b.column(0).to_numpy()
            for at in range(0, len(x), 512):
                row, direction, value = directions.ends(x[at : at + 512])
                yield pa.RecordBatch.from_arrays([pa.array(direction), pa.array(ball[at : at + 512][row]), pa.array(value)], names=["direction", "ball", "value"])

    found = balls.select("ball", "x").mapInArrow(run, "direction long, ball long, value double")
    return found.groupBy("direction", "ball").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def collisions(entries: DataFrame, window: float) -> DataFrame:
    """(a, b, n): how many directions have the balls a < b in each other's window."""

    def run(batches: Iterator[pa.RecordBatch]):
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        for batch in batches:
            kept = len(held[0])
            d, ball, low, high = held = [np.concatenate((h, batch.column(i).to_numpy())) for i, h in enumerate(held)]
            i, k = np.arange(len(d)), 1
            while len(i):
                i = i[i + k < len(d)]
                # entries come by direction and low end: once one is out of reach, so are those after it
                i = i[(d[i + k] == d[i]) & (low[i + k] <= high[i] + window)]
                new = i[i + k >= kept]
                if len(new):
                    a, b = ball[new], ball[new + k]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])
                k += 1
            there = (d == d[-1]) & (high + window >= low[-1]) if len(d) else slice(0)
            held = [h[there] for h in held]

    by = entries.repartition("direction").sortWithinPartitions("direction", "low").select("direction", "ball", "low", "high")
    return by.mapInArrow(run, "a long, b long").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _settle(pairs: DataFrame, width: int, threshold: float) -> DataFrame:
    """(a, b, verdict): 1 where all members link, 0 where none do, -1 where it takes the members."""
    angle = math.acos(threshold)

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            x, y = _matrix(b.column("a_x"), width), _matrix(b.column("b_x"), width)
            c, spread = np.einsum("ij,ij->i", x, y), b.column("a_r").to_numpy() + b.column("b_r").to_numpy()
            between = np.arccos(np.clip(c, -1, 1))
            sure = np.where(between + spread <= angle - ROOM, 1, np.where(between - spread > angle + ROOM, 0, -1))
            verdict = np.where(spread == 0, (c >= threshold).astype(np.int64), sure)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(verdict)], names=["a", "b", "verdict"])

    return pairs.mapInArrow(run, "a long, b long, verdict long")


def _packs(rows: DataFrame, total: str) -> DataFrame:
    """(big, pack): rows (big, ball, uid, x, mult) in lists of about PACK, dealt by hash; ``total`` has the number of rows of a big."""
    slot = F.pmod(F.xxhash64("uid"), F.ceil(F.col(total) / PACK).cast("long"))
    return rows.groupBy("big", slot.alias("slot")).agg(F.collect_list(F.struct("uid", "mult", "ball", "x")).alias("pack")).drop("slot")


def _count_links(met: DataFrame, width: int, threshold: float) -> DataFrame:
    """(uid, links, big, ball) of members of packs that meet: links of each member with the other pack, and for the second pack also the balls so linked."""

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            for p, q, big in zip(b.column("p"), b.column("q"), b.column("big").to_pylist()):
                p, q = p.values, q.values
                linked = _matrix(p.field("x"), width) @ _matrix(q.field("x"), width).T >= threshold
                rows, columns = linked @ q.field("mult").to_numpy(), p.field("mult").to_numpy() @ linked
                i, j = np.flatnonzero(rows), np.flatnonzero(columns)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([p.field("uid").take(pa.array(i)), q.field("uid").take(pa.array(j))]), pa.array(np.concatenate((rows[i], columns[j])), pa.int64()),
                        pa.array([None] * len(i) + [big] * len(j), pa.int64()), pa.concat_arrays([pa.nulls(len(i), pa.int64()), q.field("ball").take(pa.array(j))]),
                    ],
                    names=["uid", "links", "big", "ball"],
                )

    return met.select("p", "q", "big").mapInArrow(run, "uid long, links long, big long, ball long")


def link(df: DataFrame, threshold: float = 0.9, recall: float = 0.995, seed: int = 42, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, n_links, component_id, kept) of every row; a link is a cosine of ``threshold`` or more, and pairs at it are found with ``recall``."""
    scratch = Scratch(df.sparkSession, "links")
    width = max(8, widest(df, vector_col))
    rows = scratch.cut(unit_rows(df, id_col, vector_col, width))
    distinct = rows.where("x IS NOT NULL").groupBy("x").agg(F.count(F.lit(1)).alias("mult"), F.min("id").alias("least"))
    classes = scratch.cut(distinct.withColumn("uid", F.monotonically_increasing_id()))
    n = classes.count()
    balls = build_balls(classes, width, threshold, n, scratch, seed)
    members = balls.join(classes.select("uid", "mult", "least"), "uid")
    radius = F.max(F.when(F.col("c") < 1, F.acos("c") + ROOM).otherwise(F.when(F.col("uid") == F.col("ball"), 0.0).otherwise(ROOM)))
    about = members.groupBy("ball").agg(radius.alias("r"), F.sum("mult").alias("mult"), F.count(F.lit(1)).alias("size"), F.min("least").alias("least"))
    centres = scratch.cut(about.join(classes.select(F.col("uid").alias("ball"), "x"), "ball"))

    directions, enough = calibrated(width, n, threshold, recall, seed)
    candidates = collisions(projected(balls, width, directions), directions.window).where(F.col("n") >= enough).select("a", "b")
    side = lambda s: centres.select(F.col("ball").alias(s), F.col("x").alias(f"{s}_x"), F.col("r").alias(f"{s}_r"))
    settled = scratch.cut(_settle(candidates.join(side("a"), "a").join(side("b"), "b"), width, threshold).where("verdict <> 0"))

    # balls that link as a whole
    size = centres.select("ball", "size", "mult")
    whole = settled.where("verdict = 1")
    both = whole.select(F.col("a").alias("ball"), F.col("b").alias("other")).unionByName(whole.select(F.col("b").alias("ball"), F.col("a").alias("other")))
    by_ball = both.join(size.select(F.col("ball").alias("other"), "mult"), "other").groupBy("ball").agg(F.sum("mult").alias("ball_links"))

    # balls whose members have to be looked at: the larger one's packs meet packs of all the smaller ones that face it
    named = lambda s: size.select(F.col("ball").alias(s), F.col("size").alias(f"{s}_n"))
    unsure = settled.where("verdict < 0").join(named("a"), "a").join(named("b"), "b")
    first = (F.col("a_n") > F.col("b_n")) | ((F.col("a_n") == F.col("b_n")) & (F.col("a") < F.col("b")))
    pick = lambda x, y: F.when(first, F.col(x)).otherwise(F.col(y))
    unsure = scratch.cut(unsure.select(pick("a", "b").alias("big"), pick("b", "a").alias("ball"), pick("a_n", "b_n").alias("big_n"), pick("b_n", "a_n").alias("n")))
    facing = unsure.groupBy("big").agg(F.sum("n").alias("facing"), F.first("big_n").alias("big_n"))
    one = members.select("ball", "uid", "x", "mult")
    p = _packs(one.join(facing.select(F.col("big").alias("ball"), "big_n"), "ball").withColumn("big", F.col("ball")), "big_n")
    q = _packs(unsure.select("big", "ball").join(facing, "big").join(one, "ball"), "facing")
    counted = scratch.cut(_count_links(p.withColumnRenamed("pack", "p").join(q.withColumnRenamed("pack", "q"), "big"), width, threshold))
    by_member = counted.groupBy("uid").agg(F.sum("links").alias("member_links"))

    edges = whole.select("a", "b").unionByName(counted.where("ball IS NOT NULL").select(F.col("big").alias("a"), F.col("ball").alias("b")).distinct())
    roots = scratch.cut(connected(edges, scratch).select(F.col("node").alias("ball"), "root"))
    rooted = centres.select("ball", "mult", "least").join(roots, "ball", "left").join(by_ball, "ball", "left").withColumn("root", F.coalesce("root", "ball"))
    named_roots = rooted.groupBy("root").agg(F.min("least").alias("component"))
    found = rooted.join(named_roots, "root").select("ball", "component", (F.col("mult") - 1 + F.coalesce("ball_links", F.lit(0))).alias("links"))
    by_class = balls.select("uid", "x", "ball").join(found, "ball").join(by_member, "uid", "left").select("x", "component", (F.col("links") + F.coalesce("member_links", F.lit(0))).alias("links"))
    # the classes are cut to a table, so that a class with very many rows can be split in the join
    out = rows.join(scratch.cut(by_class), "x", "left").select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)))
