"""Helpers shared by the pipeline operators.

Words are maximal runs of characters other than space and U+0009..U+000D, which
is exactly what ``bytes.split()`` yields on UTF-8.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..plans.lineage import Scratch

__all__ = ["ARROW_ROWS", "WORD_PATTERN", "Scratch", "WordHasher", "dense", "encoded", "fresh", "signed", "small_batches", "splitmix", "table", "widest"]

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: Rows and bytes of an Arrow batch sent to Python: they bound a worker's memory when texts are long.
ARROW_ROWS, ARROW_BYTES = 512, 32 << 20

_M64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small, because one text can be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def splitmix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, vectorised."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class WordHasher:
    """64-bit hashes of all words of a text, and of windows of words, in numpy.

    A word's hash is a sum of random values, one drawn for each byte at each place (from a
    table for the first places, by a 64-bit finaliser beyond), mixed with its length: two
    different words collide with probability 2**-64 whatever their letters. A window's is a
    polynomial over word hashes modulo 2**64. Another ``seed`` gives independent hashes of both.
    Long texts go through in segments cut at white space, so the temporaries stay bounded by
    the segment and the longest word.
    """

    SEGMENT, PLACES = 1 << 20, 64

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, (1 << 64) - 1, self.PLACES * 256, dtype=np.uint64, endpoint=True)
        self.beyond = rng.integers(1, 1 << 63, dtype=np.uint64)
        self.base = int(rng.integers(1, 1 << 62)) * 2 + 1
        space = np.zeros(256, bool)
        space[[32, 9, 10, 11, 12, 13]] = True
        self.space = space
        self._tables: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    def _pair(self, n: int, factor: int = 1) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the base (times an odd factor) and of its inverse, ``n`` at least."""
        size = 1 << max(12, int(n).bit_length())
        if (size, factor) not in self._tables:
            base = (self.base * factor) & _M64
            pair = self._powers(base, size), self._powers(pow(base, -1, 1 << 64), size)
            if size > 2 * self.SEGMENT:
                return pair
            self._tables[size, factor] = pair
        return self._tables[size, factor]

    def _segment(self, raw: np.ndarray) -> np.ndarray:
        solid = ~self.space[raw]
        edge = np.diff(np.concatenate(([0], solid.view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not len(start):
            return np.zeros(0, np.uint64)
        size = end - start
        first = np.cumsum(size) - size
        letters = raw[solid]
        place = np.arange(len(letters)) - np.repeat(first, size)
        values = self.values[np.minimum(place, self.PLACES - 1) * 256 + letters]
        if size.max() > self.PLACES:
            far = place >= self.PLACES
            values[far] = splitmix((place[far].astype(np.uint64) * np.uint64(256) + letters[far]) * np.uint64(0x9E3779B97F4A7C15) + self.beyond)
        return splitmix(np.add.reduceat(values, first) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def word_hashes(self, text: bytes) -> np.ndarray:
        raw = np.frombuffer(text, np.uint8)
        if len(raw) <= self.SEGMENT:
            return self._segment(raw)
        parts, at = [], 0
        while at < len(raw):
            end = min(len(raw), at + self.SEGMENT)
            while end < len(raw) and not self.space[raw[end]]:
                step = self.space[raw[end : end + self.SEGMENT]]
                end += int(step.argmax()) if step.any() else len(step)
            parts.append(self._segment(raw[at:end]))
            at = end
        return np.concatenate(parts)

    def windows(self, hashes: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
        """Hash of the ``n`` words from each position on; another ``salt``, another hash."""
        if len(hashes) < n:
            return np.zeros(0, np.uint64)
        power, inverse = self._pair(len(hashes) + 1, 2 * salt + 3)
        prefix = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * power[: len(hashes)], out=prefix[1:])
        return splitmix((prefix[n:] - prefix[:-n]) * inverse[: len(hashes) - n + 1] + np.uint64(n))

    def texts(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Word hashes of several texts end to end, and where each begins (one more at the end)."""
        joined, counts, group, size = [], [], [], 0

        def flush() -> None:
            nonlocal group, size
            if group:
                data = b"\n".join(group)
                raw = np.frombuffer(data, np.uint8)
                solid = ~self.space[raw] if len(raw) else np.zeros(0, bool)
                edge = np.diff(np.concatenate(([0], solid.view(np.int8))))
                start = np.flatnonzero(edge == 1)
                begins = np.cumsum([0] + [len(t) + 1 for t in group])
                counts.extend(np.diff(np.searchsorted(start, begins)).tolist())
                joined.append(self.word_hashes(data))
            group, size = [], 0

        for t in texts:
            group.append(t)
            size += len(t)
            if size >= self.SEGMENT // 2:
                flush()
        flush()
        return (np.concatenate(joined) if joined else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum(counts, dtype=np.int64))).astype(np.int64)


def encoded(column) -> list[bytes]:
    """A pyarrow string column as UTF-8 bytes; null is empty."""
    import pyarrow as pa

    return [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def dense(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a pyarrow list column as float64 of ``width`` columns, zeros after a shorter one's end, and which of them are usable: not null, all components there and finite."""
    import pyarrow.compute as pc

    flat = column.flatten()
    values = flat.cast("float64").to_numpy(zero_copy_only=False) if len(flat) else np.zeros(0)
    values = np.where(np.asarray(flat.is_null()), np.nan, values) if flat.null_count else values
    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    there = ~np.asarray(column.is_null())
    row = np.repeat(np.arange(len(column)), size)
    x = np.zeros((len(column), width))
    x[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values
    ok = there & np.isfinite(x).all(1)
    x[~ok] = 0
    return x, ok


def widest(df: DataFrame, vector_col: str) -> int:
    """The greatest number of components, 0 without vectors."""
    from pyspark.sql import functions as F

    return max(0, df.agg(F.max(F.when(F.col(vector_col).isNotNull(), F.size(vector_col)))).first()[0] or 0)
