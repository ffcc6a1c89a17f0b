"""Substring dedup by level-wise doubling.

A window of ``window`` words is removed if its word sequence also starts earlier (smaller
identifier, or the same document and an earlier start). Windows are found level by level:
at the first level short windows are counted; only those that occur more than once are
extended to twice their length, and so on up to ``window``, or until none survive.

Below the last level only one short window stands for each window of twice its length:
the one with the least hash, leftmost on a tie. Equal windows choose equal ones at equal
offsets, so a repeated window always has a repeated representative, and about a sixth of
the positions have to be counted. The windows that share a representative are neighbours
and travel as one row. Windows meet by 64-bit hashes on the lower levels (a chance hit
there costs work, not results). On the last level they have to agree in two hashes of 64 bits
that come from independent hashes of the words: that of the representative and that of the
whole window (inside one document, the latter alone). Words themselves aren't compared.

What repeats inside one document is settled there: a document sends each distinct window
once. Counts are pre-aggregated before each shuffle. Representatives of up to ``hot``
documents and four times as many places are compared in order of place, one after another, so
``hot`` bounds what a task holds; for those of more (a passage that very many documents share, or one document very often) equal rows are first reduced to the first of them, only
what differs is taken apart into windows, and first places are aggregated before the
shuffle and joined back, joins that adaptive execution can split.

Defined results: identifiers are integers; null and empty texts have no words; rows that
share an identifier are told apart by their text's 64-bit hash, in its order; wholly repeated
rows count as one document, and each is returned; a null identifier is the smallest; very
long texts are read whole, a batch of Arrow rows at a time; an empty table gives an empty
result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHasher, encoded, signed, small_batches, splitmix

_KEY = "id long, tid long"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, tid, body); tid tells rows of one identifier apart."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tid"), F.col(text_col).alias("body"))


def representatives(hashes: np.ndarray, begins: np.ndarray, window: int, start: int, hasher: WordHasher) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each length from ``window`` down to ``start``: positions of its chosen windows, and of each one's representative of half the length.

    ``begins``: where each document's words begin, and the end.
    """
    last = np.repeat(begins[1:], np.diff(begins))  # end of each position's document
    at = np.flatnonzero(np.arange(len(hashes)) + window <= last)
    out, length = {}, window
    while length > start:
        half = length // 2
        if not len(at):
            out[length] = at, at
        else:
            shorter = hasher.windows(hashes, half)
            span = np.lib.stride_tricks.sliding_window_view(shorter, length - half + 1)
            out[length] = at, at + span[at].argmin(axis=1) if len(at) < len(span) // 2 else at + span.argmin(axis=1)[at]
        at, length = np.unique(out[length][1]), half
    out[start] = at, at
    return out


def _lengths(window: int, start: int) -> list[int]:
    out = [window]
    while out[-1] > start:
        if out[-1] % 2:
            raise ValueError("window must be start times a power of two")
        out.append(out[-1] // 2)
    if out[-1] != start:
        raise ValueError("window must be start times a power of two")
    return out[::-1]


def _first_equal(keys: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each element the index of the first one of its document with its key."""
    if not len(keys):
        return np.zeros(0, np.int64)
    order = np.lexsort((keys, doc))  # stable
    fresh = np.concatenate(([True], (keys[order][1:] != keys[order][:-1]) | (doc[order][1:] != doc[order][:-1])))
    out = np.empty(len(keys), np.int64)
    out[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
    return out


def _live(lists, begins: np.ndarray, n: int) -> np.ndarray:
    """Positions that the lists (of positions in each document) name."""
    out = np.zeros(n + 1, bool)
    for x, first in zip(lists.to_pylist(), begins):
        if x:
            out[np.asarray(x, np.int64) + first] = True
    return out


class _Batch:
    """Words of a batch of documents, and the windows of one length that what is known so far extends to."""

    def __init__(self, b, hasher: WordHasher, window: int, start: int, length: int):
        self.ids, self.tids = b.column(0), b.column(1)
        self.hashes, self.begins = hasher.texts(encoded(b.column(2)))
        at, under = representatives(self.hashes, self.begins, window, start, hasher)[length]
        self.under = under
        self.hot = np.zeros(len(at), bool)
        if b.num_columns > 3 and len(at):
            # lists name the first equal place of a document; all equal ones follow it
            doc = self.doc_of(under)
            first = under[_first_equal(hasher.windows(self.hashes, length // 2)[under], doc)]
            self.hot = _live(b.column(4), self.begins, len(self.hashes))[first]
            chosen = self.hot | _live(b.column(3), self.begins, len(self.hashes))[first]
            at, self.under, self.hot = at[chosen], under[chosen], self.hot[chosen]
        self.at = at

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.begins, at, side="right") - 1

    def columns(self, at: np.ndarray) -> list:
        """id, tid and place of positions."""
        doc = self.doc_of(at)
        take = pa.array(doc)
        return [self.ids.take(take), self.tids.take(take), pa.array((at - self.begins[doc]).astype(np.int32))]


def _emit(window: int, start: int, length: int):
    """Rows (h, id, tid, at, n): each distinct window of ``length`` of a document with its first place and number of places."""

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            batch = _Batch(b, hasher, window, start, length)
            if not len(batch.at):
                continue
            h = hasher.windows(batch.hashes, length)[batch.at]
            first, count = np.unique(_first_equal(h, batch.doc_of(batch.at)), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(h[first])), *batch.columns(batch.at[first]), pa.array(count)], names=["h", "id", "tid", "at", "n"])

    return run, f"h long, {_KEY}, at int, n long"


def _emit_runs(window: int, start: int):
    """Rows (h, id, tid, at, keys, mask, hot).

    A row either has the windows from place ``at`` on that one repeated representative (of
    hash h) stands for, as keys; or no keys, and a mask of windows that repeat in their own document.
    """

    def run(batches):
        hasher, other = WordHasher(), WordHasher(11)
        for b in batches:
            batch = _Batch(b, hasher, window, start, window)
            at, under = batch.at, batch.under
            if not len(at):
                continue
            keys = other.windows(other.texts(encoded(b.column(2)))[0], window)[at]
            again = _first_equal(keys, batch.doc_of(at)) != np.arange(len(at))
            # windows that repeat inside: masks of up to 31 neighbours
            own = at[again]
            if len(own):
                part = np.cumsum(np.concatenate(([0], (np.diff(own) != 1) | (np.diff(batch.doc_of(own)) != 0))))
                begin = own[np.concatenate(([True], np.diff(part) != 0))][part]
                slot = (own - begin) // 31
                edge = np.flatnonzero(np.concatenate(([True], (np.diff(part) != 0) | (np.diff(slot) != 0))))
                bits = (1 << ((own - begin) % 31)).astype(np.int64)
                mask = np.add.reduceat(bits, edge).astype(np.int32)
                n = len(edge)
                spread = splitmix(own[edge].astype(np.uint64) + keys[again][edge])
                empty = pa.array([b""] * n, pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(signed(spread)), *batch.columns(own[edge]), empty, pa.array(mask), pa.array(np.zeros(n, bool))], names=["h", "id", "tid", "at", "keys", "mask", "hot"])
            at, under, keys, hot = at[~again], under[~again], keys[~again], batch.hot[~again]
            if not len(at):
                continue
            edge = np.flatnonzero(np.concatenate(([True], (under[1:] != under[:-1]) | (np.diff(at) != 1))))
            offsets = (np.concatenate((edge, [len(at)])) * 8).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(keys.tobytes())])
            h = hasher.windows(batch.hashes, window // 2)[under[edge]]
            yield pa.RecordBatch.from_arrays([pa.array(signed(h)), *batch.columns(at[edge]), binary, pa.array(np.zeros(len(edge), np.int32)), pa.array(hot[edge])], names=["h", "id", "tid", "at", "keys", "mask", "hot"])

    return run, f"h long, {_KEY}, at int, keys binary, mask int, hot boolean"


def _later_in_order(batches):
    """Of runs sorted by h and place: (id, tid, at, mask), the bits of ``mask`` for the windows that have an earlier equal one."""
    held = None  # elements of the last group: h, key, null id, id, tid, place
    for b in batches:
        if not b.num_rows:
            continue
        data = b.column(4)
        offsets = np.frombuffer(data.buffers()[1], np.int32)[data.offset : data.offset + len(data) + 1]
        size = np.diff(offsets) // 8
        key = np.frombuffer(data.buffers()[2], np.uint64, int(offsets[-1] - offsets[0]) // 8, int(offsets[0]))
        row = np.repeat(np.arange(len(size)), size)
        bit = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        of = lambda i: b.column(i).fill_null(0).to_numpy(zero_copy_only=False)
        none = b.column(1).is_null().to_numpy(zero_copy_only=False)
        new = [of(0)[row], key, none[row], of(1)[row], of(2)[row], of(3)[row] + bit]
        before = 0
        if held is not None and len(row) and held[0][0] == new[0][0]:
            before = len(held[0])
            new = [np.concatenate(x) for x in zip(held, new)]
        h, key, none_, id_, tid, at = new
        order = np.lexsort((np.arange(len(h)), key, h))
        fresh = np.concatenate(([True] * (len(h) > 0), (h[order][1:] != h[order][:-1]) | (key[order][1:] != key[order][:-1])))
        first = order[np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))]
        later = np.zeros(len(h), bool)
        later[order] = (none_[order] != none_[first]) | (id_[order] != id_[first]) | (tid[order] != tid[first]) | (at[order] != at[first])
        if len(h):
            last = h == h[-1]
            held = [x[last] for x in new]
        later = later[before:]
        mask = of(5).astype(np.int32)
        np.bitwise_or.at(mask, row[later], (1 << bit[later]).astype(np.int32))
        found = np.flatnonzero(mask)
        if len(found):
            take = pa.array(found)
            yield pa.RecordBatch.from_arrays([b.column(1).take(take), b.column(2).take(take), b.column(3).take(take), pa.array(mask[found])], names=["id", "tid", "at", "mask"])


def _later_in_hot(runs: DataFrame, scratch: Scratch) -> DataFrame:
    """The same for runs of hot representatives, without bringing a representative's runs together."""
    place = F.struct("id", "tid", "at")
    firsts = scratch.cut(runs.groupBy("h", "keys").agg(F.min(place).alias("first")))
    # a run that equals an earlier one is wholly later
    every_bit = F.expr("shiftleft(1, CAST(octet_length(keys) / 8 AS INT)) - 1").alias("mask")
    equal = runs.join(firsts, ["h", "keys"]).where(~place.eqNullSafe(F.col("first"))).select("id", "tid", "at", every_bit)
    # the first of equal runs may still share windows with other runs
    spread = firsts.select("h", "first.*", F.posexplode(F.expr("transform(sequence(1, CAST(octet_length(keys) / 8 AS INT)), k -> substring(keys, k * 8 - 7, 8))")).alias("k", "key"))
    spread = spread.select("h", "key", "id", "tid", (F.col("at") + F.col("k")).alias("at"))
    known = scratch.cut(spread.groupBy("h", "key").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "key", "first"))
    shared = spread.join(known, ["h", "key"]).where(~place.eqNullSafe(F.col("first"))).select("id", "tid", "at", F.lit(1).alias("mask"))
    return equal.unionByName(shared)


def _with_positions(rows: DataFrame, found: DataFrame, how: str, *names: str) -> DataFrame:
    found = found.select(F.col("id").alias("f_id"), F.col("tid").alias("f_tid"), *names)
    return rows.join(found, F.col("id").eqNullSafe(F.col("f_id")) & (F.col("tid") == F.col("f_tid")), how).select("id", "tid", "body", *names)


def repeated_windows(docs: DataFrame, window: int = 20, start: int | None = None, id_col: str = "doc_id", text_col: str = "text", hot: int = 50_000) -> DataFrame:
    """id, tid, runs: for each text that has any, (at, mask) of the windows that occur earlier; bit k of a mask is the window at word ``at + k``."""
    small_batches(docs.sparkSession)
    start = start or window // 2
    lengths, found = _lengths(window, start), None
    if start == window or window // 2 + 1 > 31:
        raise ValueError("start must be shorter than window, and window at most 60")
    scratch = Scratch(docs.sparkSession, "substrings")
    rows = _rows(docs, id_col, text_col)
    empty = docs.sparkSession.createDataFrame([], f"{_KEY}, runs array<struct<at:int,mask:int>>")
    for length in lengths[:-1]:
        run, schema = _emit(window, start, length)
        seen = (rows if found is None else _with_positions(rows, found, "inner", "ats", "hots")).mapInArrow(run, schema)
        more = scratch.cut(seen.groupBy("h").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs")).where("n > 1").select("h", ((F.col("docs") > hot) | (F.col("n") > 4 * hot)).alias("hot")))
        lists = [F.collect_list(F.when(~F.col("hot"), F.col("at"))).alias("ats"), F.collect_list(F.when(F.col("hot"), F.col("at"))).alias("hots")]
        after = scratch.cut(seen.join(more, "h").groupBy("id", "tid").agg(*lists))
        scratch.drop(more)
        if found is not None:
            scratch.drop(found)
        found = after
        if found.isEmpty():
            return empty
    run, schema = _emit_runs(window, start)
    runs = _with_positions(rows, found, "inner", "ats", "hots").mapInArrow(run, schema)
    any_hot = not found.where(F.size("hots") > 0).isEmpty()
    cold = (runs.where("NOT hot") if any_hot else runs).select("h", "id", "tid", "at", "keys", "mask")
    every = cold.repartition("h").sortWithinPartitions("h", "id", "tid", "at").mapInArrow(_later_in_order, f"{_KEY}, at int, mask int")
    if any_hot:
        every = every.unionByName(_later_in_hot(runs.where("hot").select("h", "id", "tid", "at", "keys"), scratch))
    return every.groupBy("id", "tid").agg(F.collect_list(F.struct("at", "mask")).alias("runs"))


def remove_repeats(docs: DataFrame, window: int = 20, start: int | None = None, id_col: str = "doc_id", text_col: str = "text", texts: bool = True, hot: int = 50_000) -> DataFrame:
    """One row an input row: id, n_words, n_removed, kept (the words that stay, joined by one space; null without ``texts``), kept_sha256."""
    joined = _with_positions(_rows(docs, id_col, text_col), repeated_windows(docs, window, start, id_col, text_col, hot), "left", "runs")

    def run(batches):
        for b in batches:
            n_words, n_removed, kept = [], [], []
            lists = b.column(3)
            ends = lists.offsets.to_numpy()
            at = lists.values.field(0).to_numpy()
            mask = lists.values.field(1).to_numpy()
            for i, text in enumerate(encoded(b.column(2))):
                found = text.split()
                n_words.append(len(found))
                if ends[i + 1] > ends[i]:
                    edge = np.zeros(len(found) + 1, np.int64)
                    a, m = at[ends[i] : ends[i + 1]], mask[ends[i] : ends[i + 1]]
                    for k in range(int(m.max()).bit_length()):
                        starts = np.unique(a[(m >> k) & 1 == 1]) + k
                        np.add.at(edge, starts, 1)
                        np.subtract.at(edge, starts + window, 1)
                    stays = np.cumsum(edge[:-1]) == 0
                    found = list(itertools.compress(found, stays.tolist()))
                n_removed.append(n_words[-1] - len(found))
                kept.append(b" ".join(found))
            digest = [hashlib.sha256(x).hexdigest() for x in kept]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([x.decode("utf-8", "surrogatepass") if texts else None for x in kept], pa.string()), pa.array(digest)],
                names=["id", "n_words", "n_removed", "kept", "kept_sha256"],
            )

    return joined.mapInArrow(run, "id long, n_words long, n_removed long, kept string, kept_sha256 string")
