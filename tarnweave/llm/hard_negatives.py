"""Hard negatives by a two-dimensional block matrix multiply.

Rows are packed into blocks, and each block into chunks of dimensions; the anchors of a block are
packed beside it. Anchor and row blocks are dealt to the cells of a grid, all chunks of a pair of blocks to one cell, which
multiplies them, some anchors at a time, and keeps only the best: first the best rows of the
anchor's own label, then, multiplied again with an anchor's positives known, the best rows of other labels in
each positive's window. No scores are written or shuffled but those of the best. A task holds the few blocks of a cell, whatever the size of a label.

Scores are inner products of floor(scale * component) and exact: rows whose squared sum is
beyond 2**53 take no part, which bounds every partial sum.

Defined results: rows with a null identifier, label or vector, or with a null or non-finite
component take no part; shorter vectors count as filled up with zeros, an empty one as zeros; repeated
rows are rows of their own (one can be the other's positive); equal scores go by smaller identifier; an
anchor without positives, or a positive with an empty window, gives no rows; an empty table gives none;
other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, dense, small_batches, widest

BLOCK_BITS, CHUNK, SIDE = 12, 32, 4
#: Anchors of a cell that are multiplied at a time.
SLICE = 256
EXACT = float(1 << 53)

PACKED = "block long, part int, n int, pos binary, ids binary, labels binary, m binary"


def _longs(raw: bytes | None) -> np.ndarray:
    return np.frombuffer(raw or b"", np.int64)


def pack(rows: DataFrame, width: int, scale: float, chunk: int) -> DataFrame:
    """Blocks of (id, label, anchor, vec): one row a chunk of dimensions for the block's rows (anchor false) and one for its anchors (anchor true)."""
    small_batches(rows.sparkSession)
    parts = max(1, -(-width // chunk))
    full = 1 << BLOCK_BITS

    def run(batches: Iterator[pa.RecordBatch]):
        part_of, made, held = TaskContext.get().partitionId(), 0, []

        def emit():
            nonlocal made, held
            ids, labels, anchor, x = (np.concatenate(c) for c in zip(*held))
            held = [(ids[full:], labels[full:], anchor[full:], x[full:])] if len(ids) > full else []
            ids, labels, anchor, x = ids[:full], labels[:full], anchor[:full], x[:full]
            block, made = (part_of << 20) + made, made + 1
            out = []
            for flag, pos in ((False, np.arange(len(ids))), (True, np.flatnonzero(anchor))):
                for p in range(parts if len(pos) else 0):
                    head = (pos.astype(np.int64).tobytes(), ids[pos].tobytes(), labels[pos].tobytes()) if p == 0 else (None, None, None)
                    out.append((flag, block, p, len(pos), *head, np.ascontiguousarray(x[pos, p * chunk : (p + 1) * chunk]).tobytes()))
            kinds = [pa.bool_(), pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 4]
            names = ["anchor", "block", "part", "n", "pos", "ids", "labels", "m"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

        for b in batches:
            x, ok = dense(b.column(3), width)
            x = np.floor(scale * x)
            ok &= (x * x).sum(1) <= EXACT
            if not ok.any():
                continue
            kept = b.filter(pa.array(ok))
            held.append((kept.column(0).to_numpy(), kept.column(1).to_numpy(), kept.column(2).to_numpy(zero_copy_only=False), x[ok].astype(np.int64)))
            while sum(len(h[0]) for h in held) >= full:
                yield emit()
        if sum(len(h[0]) for h in held):
            yield emit()

    return rows.select("id", "label", "anchor", "vec").mapInArrow(run, f"anchor boolean, {PACKED}")


def _grid(blocks: DataFrame, side: int) -> tuple[DataFrame, DataFrame]:
    """Anchor chunks and row chunks by the cells (a_cell, b_cell) of the grid where they meet: every pair of blocks in one cell.

    A cell holds about ``side`` blocks of rows and as many anchors as rows, so rows are copied once for each of so many anchors.
    """
    n, anchors = blocks.where("part = 0").agg(F.count_if(~F.col("anchor")), F.coalesce(F.sum(F.when(F.col("anchor"), F.col("n"))), F.lit(0))).first()
    a_cells, b_cells = max(1, -(-anchors // (side << BLOCK_BITS))), max(1, -(-n // side))
    home = lambda cells: F.pmod(F.xxhash64("block"), F.lit(cells)).cast("int")
    every = lambda cells: F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))
    a = blocks.where("anchor").drop("anchor").withColumn("a_cell", home(a_cells)).withColumn("b_cell", every(b_cells))
    b = blocks.where("NOT anchor").drop("anchor").withColumn("b_cell", home(b_cells)).withColumn("a_cell", every(a_cells))
    return a, b


def _side(table: pa.Table) -> tuple:
    """Blocks, unique numbers, identifiers, labels and vectors of the rows of a cell."""
    parts: dict = {}
    for row in table.to_pylist():
        parts.setdefault(row["block"], []).append(row)
    out = []
    for block, rows in parts.items():
        rows.sort(key=lambda r: r["part"])
        head = rows[0]
        x = np.concatenate([_longs(r["m"]).reshape(r["n"], -1) for r in rows], 1).astype(np.float64)
        out.append((np.full(head["n"], block), (block << BLOCK_BITS) + _longs(head["pos"]), _longs(head["ids"]), _longs(head["labels"]), x))
    return tuple(np.concatenate(c) for c in zip(*out))


def _tiles(anchors: pa.Table, rows: pa.Table) -> Iterator[tuple]:
    """Exact scores of the anchors of a cell, ``SLICE`` at a time, with all rows of the cell."""
    a, b = _side(anchors), _side(rows)
    for at in range(0, len(a[0]), SLICE):
        some = tuple(x[at : at + SLICE] for x in a)
        # sums of integers below 2**53 are exact in doubles
        yield *some[:4], *b[1:4], (some[4] @ b[4].T).astype(np.int64)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller identifier."""
    if len(scores) > k:
        there = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return there[np.lexsort((ids[there], -scores[there]))][:k]
    return np.lexsort((ids, -scores))


def _table(rows: list[tuple], names: list[str]) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [[]] * len(names))], names=names)


def _cells(a: DataFrame, b: DataFrame, run, names: list[str]) -> DataFrame:
    by = ("a_cell", "b_cell")
    # names of their own: both sides come from one table
    b = b.toDF(*[c if c in by else f"{c}_b" for c in b.columns])
    return a.groupBy(*by).cogroup(b.groupBy(*by)).applyInArrow(lambda x, y: _table(run(x, y.rename_columns([c.removesuffix("_b") for c in y.schema.names])) if x.num_rows and y.num_rows else [], names), ", ".join(f"{c} long" for c in names))


def cell_positives(a: DataFrame, b: DataFrame, k: int) -> DataFrame:
    """The k best other rows of the anchor's label in each cell: (a_block, a_uid, anchor_id, p_uid, positive_id, positive_score)."""

    def run(anchors: pa.Table, rows: pa.Table) -> list[tuple]:
        out = []
        for blocks, uids, a_ids, a_labels, own, b_ids, b_labels, tile in _tiles(anchors, rows):
            for i, uid in enumerate(uids):
                there = np.flatnonzero((b_labels == a_labels[i]) & (own != uid))
                for j in there[_best(tile[i, there], b_ids[there], k)]:
                    out.append((blocks[i], uid, a_ids[i], own[j], b_ids[j], tile[i, j]))
        return out

    return _cells(a, b, run, ["a_block", "a_uid", "anchor_id", "p_uid", "positive_id", "positive_score"])


def cell_negatives(a: DataFrame, b: DataFrame, k: int, low: int, high: int) -> DataFrame:
    """The k best rows of other labels in the window of each of ``positives`` (a list of the block's anchors' positives), by cell."""

    def run(anchors: pa.Table, rows: pa.Table) -> list[tuple]:
        wanted: dict = {}
        for mine in anchors.column("positives").to_pylist():
            for p in mine or ():
                wanted.setdefault(p["a_uid"], []).append(p)
        out = []
        for _, uids, a_ids, a_labels, _, b_ids, b_labels, tile in _tiles(anchors, rows):
            for i, uid in enumerate(uids):
                s, other = tile[i], b_labels != a_labels[i]
                for p in wanted.get(int(uid), ()):
                    score = p["positive_score"]
                    there = np.flatnonzero(other & (100 * s >= low * score) & (100 * s <= high * score))
                    for j in there[_best(s[there], b_ids[there], k)]:
                        out.append((uid, p["p_uid"], a_ids[i], p["positive_id"], b_ids[j], score, s[j]))
        return out

    return _cells(a, b, run, ["a_uid", "p_uid", "anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"])


def _top(rows: DataFrame, by: list[str], score: str, tie: list[str], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(score), *tie))).where(F.col("rank") <= k)


def mine(
    rows: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256, chunk: int = CHUNK, side: int = SIDE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows where ``anchor`` holds.

    An anchor's ``positives`` best rows of its own label, and for each of them its ``negatives`` best rows of other labels
    with a score between ``low`` and ``high`` per cent of the positive's.
    """
    scratch = Scratch(rows.sparkSession, "negatives")
    taken = rows.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.col(vector_col).isNotNull())
    taken = taken.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("vec"))
    blocks = scratch.cut(pack(taken, widest(taken, "vec"), scale, chunk))
    a, b = _grid(blocks, side)
    best = _top(cell_positives(a, b, positives), ["a_uid"], "positive_score", ["positive_id", "p_uid"], positives)
    lists = best.groupBy(F.col("a_block").alias("block")).agg(F.collect_list(F.struct("a_uid", "p_uid", "positive_id", "positive_score")).alias("positives")).withColumn("part", F.lit(0))
    found = _top(cell_negatives(a.join(scratch.cut(lists), ["block", "part"], "left"), b, negatives, low, high), ["a_uid", "p_uid"], "negative_score", ["negative_id"], negatives)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
