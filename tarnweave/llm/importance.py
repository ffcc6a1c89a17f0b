"""Importance resampling towards a target distribution over hashed n-grams.

Features are runs of one to three words, hashed to buckets by CRC32. A bucket's gain is the
log ratio of its smoothed shares in the target and in the corpus, so a document's weight, the
sum of gains over its features, is an array lookup. Documents are drawn without replacement
by Gumbel keys: the k highest of weight plus noise. The k-th key is found by radix selection:
each pass counts one digit of the rows that still share the prefix, first on the score, then on
the identifier among rows of the last score, so the driver sees one histogram a pass. Only the
drawn rows are range-sorted and ranked.

CRCs of longer runs come from those of the words, as CRC32 of a concatenation is a linear map
of the first part's, tabulated by the second's length.

Defined results: null and empty texts have no features, weight 0 and are never drawn; a null
identifier is hashed as the empty string and comes last in a tie; of rows that repeat identifier
and score any may be drawn, as many as the count wants; very long texts are taken apart in
segments and read whole; an empty table gives no rows; an empty target gives weights all the same;
other columns are not looked at.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, encoded, small_batches

BUCKETS, DIGIT_BITS = 10_000, 12

WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_GAP = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]")


class RunHasher:
    """CRC32 of every run of one to three words, of several texts together."""

    SEGMENT, BLOCK, LONG, PLACES = 1 << 20, 1 << 18, 256, 64

    def __init__(self, buckets: int = BUCKETS):
        self.buckets = buckets
        plain = np.array([self._plain(b) for b in range(256)], np.uint32)
        self.plain, self.solid = plain, np.array([bool(WORD.match(bytes([b]))) for b in range(256)]).view(np.int8)
        # shifts[n][j][b]: what byte j of a CRC becomes after n more zero bytes
        now = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
        shifts = [now]
        for _ in range(self.LONG - 1):
            now = plain[now & 255] ^ (now >> np.uint32(8))
            shifts.append(now)
        self.shifts = np.stack(shifts).reshape(-1)

    @staticmethod
    def _plain(b: int) -> int:
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return b

    def _shift(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """``crc`` after ``n`` more bytes, without what these bytes add."""
        far = n >= self.LONG
        if far.any():
            crc, n = crc.copy(), n.copy()
            while (far := n >= self.LONG).any():
                crc[far] = self._shift(crc[far], np.full(int(far.sum()), self.LONG - 1, n.dtype))
                n[far] -= self.LONG - 1
        at = n.astype(np.int64) * 1024
        out = self.shifts[at + (crc & np.uint32(255))]
        for j in (1, 2, 3):
            out ^= self.shifts[at + (256 * j) + (crc >> np.uint32(8 * j) & np.uint32(255))]
        return out

    def _segment(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(text, np.uint8)
        edge = np.diff(np.concatenate(([0], self.solid[raw], [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        size = (end - start).astype(np.int32)
        out = np.empty(len(size), np.uint32)
        far = np.flatnonzero(size > self.PLACES)
        for i in far:
            out[i] = zlib.crc32(text[start[i] : end[i]])
        # the others letter by letter, longest first, so that the words that go on are always the first ones
        order = np.argsort(-np.where(size > self.PLACES, 0, size).astype(np.int16), kind="stable")[: len(size) - len(far)]
        at, crc = start[order], np.full(len(order), 0xFFFFFFFF, np.uint32)
        going = np.searchsorted(-size[order], -np.arange(self.PLACES), "left") if len(order) else []
        for place, n in enumerate(going):
            if not n:
                break
            now = crc[:n]
            crc[:n] = self.plain[(now ^ raw[at[:n] + place]) & np.uint32(255)] ^ now >> np.uint32(8)
        out[order] = ~crc
        return out, size

    def words(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """CRCs and lengths of the words of a text in small letters."""
        parts, at = [], 0
        while at < len(text):
            end = at + self.SEGMENT
            if end < len(text):
                gap = _GAP.search(text, end)
                end = gap.start() if gap else len(text)
            parts.append(self._segment(text[at:end]))
            at = end
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int32)
        return tuple(np.concatenate(x) for x in zip(*parts))

    def runs(self, crc: np.ndarray, size: np.ndarray, doc: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(document, bucket) of all runs, in blocks; the words come with the number of their document."""
        space = np.uint32(zlib.crc32(b" "))
        for at in range(0, len(crc), self.BLOCK):
            c, n, d = (x[at : at + self.BLOCK + 2] for x in (crc, size, doc))
            mine = min(self.BLOCK, len(c))
            yield d[:mine], c[:mine] % np.uint32(self.buckets)
            spaced = self._shift(np.full(len(c), space), n) ^ c  # of a space and the word
            run = c
            for k in (1, 2):
                if len(c) <= k:
                    break
                run = self._shift(run[:-1], n[k:] + 1) ^ spaced[k:]
                upto = min(mine, len(run))
                whole = d[:upto] == d[k : k + upto]
                yield d[:upto][whole], run[:upto][whole] % np.uint32(self.buckets)

    def groups(self, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first text, number of texts, word CRCs, sizes, document numbers from 0 on), about a segment of bytes each."""
        at = 0
        while at < len(texts):
            size, upto = 0, at
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= self.SEGMENT):
                size += len(texts[upto])
                upto += 1
            joined = b"\n".join(texts[at:upto]).lower()
            crcs, sizes = self.words(joined)
            ends = np.cumsum([len(t) + 1 for t in texts[at:upto]])
            first = np.flatnonzero(np.diff(np.concatenate(([0], self.solid[np.frombuffer(joined, np.uint8)]))) == 1)
            yield at, upto - at, crcs, sizes, np.searchsorted(ends, first, "right")
            at = upto


def bucket_counts(df: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts, summed in each task first."""
    small_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]):
        hasher, total = RunHasher(buckets), np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, crc, size, doc in hasher.groups(encoded(b.column(0))):
                for _, bucket in hasher.runs(crc, size, doc):
                    total += np.bincount(bucket, minlength=buckets)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], names=["bucket", "n"])

    return df.select(F.col(text_col).alias("text")).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> np.ndarray:
    """floor(1000 * ln) of the ratio of smoothed shares, by bucket."""
    big_s, big_t = float(sum(source.values())), float(sum(target.values()))
    ratio = lambda b: (target.get(b, 0) + 1.0) * (big_s + buckets) / ((source.get(b, 0) + 1.0) * (big_t + buckets))
    return np.array([math.floor(1000 * math.log(ratio(b))) for b in range(buckets)], np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each row; ``gain`` has one number a bucket."""
    small_batches(docs.sparkSession)
    schema = docs.select(F.col(id_col).alias("id")).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")

    def run(batches: Iterator[pa.RecordBatch]):
        hasher = RunHasher(len(gain))
        for b in batches:
            texts = encoded(b.column(1))
            words, features, weight = (np.zeros(len(texts), np.int64) for _ in range(3))
            for at, n, crc, size, doc in hasher.groups(texts):
                words[at : at + n] = np.bincount(doc, minlength=n)
                for d, bucket in hasher.runs(crc, size, doc):
                    if not len(d):
                        continue
                    features[at : at + n] += np.bincount(d, minlength=n)
                    first = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))  # documents come in order
                    weight[at + d[first]] += np.add.reduceat(gain[bucket], first)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, pa.int64()) for x in (words, features, weight))], names=["id", "n_words", "n_features", "weight"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def gumbel(id_col: str = "id", seed: int = 42) -> Column:
    """floor(-1000 ln(-ln u)) with u from the first 32 bits of a SHA-256 of seed and identifier."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def radix_select(rows: DataFrame, key: str, k: int, descending: bool = False, bits: int = DIGIT_BITS) -> tuple[int, int] | None:
    """The k-th value (from 1) of a long column and how many rows come before that value; None with fewer rows than k.

    A pass counts one digit of ``bits`` bits among the rows that share the digits before; the leading digits that all
    rows share are skipped. Nulls have to be left out before.
    """
    low, high, n = rows.agg(F.min(key), F.max(key), F.count(key)).first()
    if not 1 <= k <= n:
        return None
    prefix, before = 0, 0
    big = lambda x: F.lit(str(x)).cast("decimal(38,0)")  # noqa: E731  the range of two longs can be beyond a long
    place = (big(high) - F.col(key)) if descending else (F.col(key) - big(low))  # in order, from 0
    width = max(1, math.ceil((high - low).bit_length() / bits))
    for level in range(width - 1, -1, -1):
        unit = 1 << (bits * level)
        inside = rows.where((place >= big(prefix)) & (place < big(prefix + (unit << bits))))
        digit = F.call_function("div", place - big(prefix), big(unit)).cast("int")
        for d, count in sorted(inside.groupBy(digit.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect()):  # at most 2**bits rows
            if before + count >= k:
                prefix += d * unit
                break
            before += count
    return (high - prefix if descending else low + prefix), before


def draw(scored: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20) -> DataFrame:
    """``scored`` (id long, n_words, score, ...) and the rank of the drawn rows: floor(share of the rows of at least ``least_words``) highest scores, ties to the smaller id."""
    scratch = Scratch(scored.sparkSession, "draw")
    fit = scored.where(F.col("n_words") >= least_words)
    k = fit.count() * share[0] // share[1]
    if not k:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    last, before = radix_select(fit, "score", k, descending=True)
    tied = fit.where((F.col("score") == last) & F.col("id").isNotNull())
    found = radix_select(tied, "id", k - before)
    # of a tie that goes beyond the known ids all stay for the ranking, which ends at k
    in_tie = F.col("id") <= F.lit(found[0]) if found else F.lit(True)
    chosen = F.coalesce((F.col("n_words") >= least_words) & ((F.col("score") > last) | ((F.col("score") == last) & in_tie)), F.lit(False))
    order = [F.desc("score"), F.asc_nulls_last("id")]
    runs = scratch.cut(scored.where(chosen).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    starts = runs.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)).cast("long")
    ranked = runs.withColumn("place", place).join(starts, "part").withColumn("rank", F.col("before") + F.col("place"))
    ranked = ranked.select(*scored.columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank"))
    return scored.where(~chosen).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)


def resample(docs: DataFrame, target: DataFrame, share: tuple[int, int] = (5, 100), least_words: int = 20, seed: int = 42, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of ``docs``; undrawn rows have no rank."""
    source, wanted = (dict(map(tuple, bucket_counts(df, c, buckets).collect())) for df, c in ((docs, text_col), (target, target_text_col)))  # a number a bucket
    weighed = weigh(docs, gains(source, wanted, buckets), id_col, text_col)
    scored = Scratch(docs.sparkSession, "weights").cut(weighed.withColumn("score", F.col("weight") + gumbel("id", seed)))
    return draw(scored, share, least_words)
