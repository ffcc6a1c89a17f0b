"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

Texts are compared as case-folded words without punctuation (NFC). Each benchmark item takes
its rare n-grams as seeds: of those that any document has, the rarest share by the number of
documents in the whole corpus, and all that are at most ``slack`` times as frequent as the
last of these. The limit is never absolute, so a passage that is copied into very many
documents keeps its seeds, and those that survive in an edited copy stay seeds beside those
that only whole copies have. A document that has a seed is aligned with the item around it;
the score is the best local alignment's (match 1, mismatch and gap -0.5 a word) divided by
the item's length in words. A pair counts from ``least`` on. Alignments take memory in
proportion to the region, not to region times item.

The benchmark is a stated query set: it reaches the driver and the tasks as sorted arrays, in
blocks of at most ``block_words`` words (at least one item; some 230 MB on the driver while a full one is
built, 45 MB a task at most). A block takes two passes over the documents, one for the frequencies and one for the
matches, so a benchmark of up to ``block_words`` words takes two passes in all.

Defined results: null text or item has no words; items without words match nothing;
items of fewer words than an n-gram use all of their words as one seed; of several regions
or ends with the best score the first counts; repeated rows are judged alike; very long texts
are read whole; an empty benchmark or table gives an empty result; other columns are not
looked at, whatever their names.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import WordHasher, encoded, small_batches

#: Words of the benchmark that two passes over the documents settle.
BLOCK_WORDS = 2_000_000

_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()
#: UTF-8 of punctuation and spaces in Latin-1, General Punctuation, and CJK Symbols.
_MARKS = re.compile(rb"\xc2[\xa0-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf]|\xe2\x80[\x80-\xbf]|\xe2\x81[\x80-\xaf]|\xe3\x80[\x80-\x84\x88-\x9f]")


def plain(text: bytes) -> bytes:
    if not text.isascii():
        text = unicodedata.normalize("NFC", text.decode("utf-8", "surrogatepass")).casefold().encode("utf-8", "surrogatepass")
        text = _MARKS.sub(b" ", text)
    return text.translate(_PLAIN)


def align(item: np.ndarray, text: np.ndarray, miss: float = 0.5, gap: float = 0.5) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: score, and the span of ``text`` (end exclusive).

    Row by row; each cell carries where its alignment began, so no table is kept.
    """
    n = len(text)
    places, slope = np.arange(n + 1), gap * np.arange(n + 1)
    over, begin, best = np.zeros(n + 1), places.copy(), (0.0, 0, 0)
    for word in item:
        row = over - gap
        start = np.where(row > 0, begin, places)
        np.maximum(row, 0, out=row)
        across = over[:-1] + np.where(text == word, 1.0, -miss)
        better = np.flatnonzero(across > row[1:])
        row[better + 1] = across[better]
        start[better + 1] = begin[better]
        # gaps along the text: the best of all earlier cells less their distance
        row += slope
        top = np.maximum.accumulate(row)
        over = top - slope
        begin = start[np.maximum.accumulate(np.where(row >= top, places, 0))]
        end = int(over.argmax())
        if over[end] > best[0]:
            best = float(over[end]), int(begin[end]), end
    return best


class Grams:
    """The different n-grams of one length, sorted, and where each stands: items and offsets of ``first[k]`` to ``first[k + 1]``."""

    def __init__(self, hashes: np.ndarray, item: np.ndarray, offset: np.ndarray):
        self.known, k = np.unique(hashes, return_inverse=True)
        order = np.lexsort((offset, item, k))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(k, minlength=len(self.known)))))
        self.item, self.offset = item[order].astype(np.int32), offset[order].astype(np.int32)

    def places(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All places of the n-grams ``k``: which of ``k``, and the place."""
        size = self.first[k + 1] - self.first[k]
        which = np.repeat(np.arange(len(k)), size)
        return which, np.arange(len(which)) + np.repeat(self.first[k] - (np.cumsum(size) - size), size)

    def seed(self, frequency: np.ndarray, share: float, fewest: int, slack: float) -> None:
        """Only the rare n-grams of each item stay, of those that any document has."""
        k = np.repeat(np.arange(len(self.known)), np.diff(self.first))
        item, k = np.unique(np.stack((self.item, k))[:, frequency[k] > 0], axis=1)
        order = np.lexsort((frequency[k], item))
        item, k = item[order], k[order]
        _, begin, of, size = np.unique(item, return_index=True, return_inverse=True, return_counts=True)
        last = begin + np.minimum(size, np.maximum(fewest, np.rint(share * size).astype(np.int64))) - 1
        live = np.unique(k[frequency[k] <= (slack * frequency[k[last]])[of]])
        _, place = self.places(live)
        self.known, self.item, self.offset, self.first = (
            self.known[live], self.item[place], self.offset[place], np.concatenate(([0], np.cumsum(self.first[live + 1] - self.first[live]))),
        )


class Matcher:
    """A block of items with their n-grams, and later their seeds: arrays of at most 24 bytes a word."""

    def __init__(self, items: list[tuple], size: int = 3):
        hasher = WordHasher()
        words, begins = hasher.texts([plain((text or "").encode("utf-8", "surrogatepass")) for _, text in items])
        there = np.flatnonzero(np.diff(begins))
        self.keys, self.words, self.begins = [items[i][0] for i in there], words, np.append(begins[there], len(words))
        length = np.diff(self.begins)
        self.grams: dict[int, Grams] = {}
        for n in range(1, size + 1):
            own = np.flatnonzero(length == n) if n < size else np.flatnonzero(length >= n)
            if len(own):
                h, count = hasher.windows(words, n), length[own] - n + 1
                item = np.repeat(own, count)
                offset = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
                self.grams[n] = Grams(h[self.begins[item] + offset], item, offset)

    def known(self) -> dict[int, np.ndarray]:
        return {n: g.known for n, g in self.grams.items()}

    def seed(self, frequency: np.ndarray, share: float, fewest: int, slack: float) -> None:
        """``frequency``: of all n-grams, shorter ones first."""
        base = 0
        for g in self.grams.values():
            n = len(g.known)
            g.seed(frequency[base : base + n], share, fewest, slack)
            base += n

    def _starts(self, hasher: WordHasher, words: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each document with seeds: the items, and where each would begin by a seed, in that order."""
        found = [(at, np.full(len(at), n), k, doc) for n, at, k, doc in hits(self.known(), hasher, words, begins)]
        if not found:
            return
        at, size, k, doc = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(doc, kind="stable")
        at, size, k, doc = at[order], size[order], k[order], doc[order]
        docs, first = np.unique(doc, return_index=True)
        for d, a, b in zip(docs.tolist(), first.tolist(), [*first[1:].tolist(), len(doc)]):
            item, start = [], []
            for n, g in self.grams.items():
                mine = np.flatnonzero(size[a:b] == n) + a
                which, place = g.places(k[mine])
                item.append(g.item[place])
                start.append(at[mine][which] - g.offset[place])
            item, start = np.concatenate(item), np.concatenate(start)
            order = np.lexsort((start, item))
            yield d, item[order], start[order]

    def find(self, hasher: WordHasher, texts: list[bytes], least: float) -> list[dict]:
        """Of each text: item index -> (score, first word, end word) where the score is ``least`` or more."""
        words, begins = hasher.texts([plain(t) for t in texts])
        out: list[dict] = [{} for _ in texts]
        for d, item, start in self._starts(hasher, words, begins):
            first, stop = int(begins[d]), int(begins[d + 1])
            reach = (self.begins[item + 1] - self.begins[item]) // 2 + 2
            # seeds near one another share a region
            cut = np.flatnonzero((np.diff(item) != 0) | (np.diff(start) > 2 * reach[1:])) + 1
            for x, y in zip([0, *cut.tolist()], [*cut.tolist(), len(item)]):
                i = int(item[x])
                body = self.words[self.begins[i] : self.begins[i + 1]]
                a, b = max(first, int(start[x] - reach[x])), min(stop, int(start[y - 1] + len(body) + reach[x]))
                score, begin, end = align(body, words[a:b])
                if score / len(body) >= max(least, out[d].get(i, (0.0,))[0]) and score / len(body) > out[d].get(i, (0.0,))[0]:
                    out[d][i] = score / len(body), a + begin - first, a + end - first
        return out


def hits(known: dict[int, np.ndarray], hasher: WordHasher, words: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram length: positions, their n-gram, their document."""
    for n, grams in known.items():
        h = hasher.windows(words, n)
        k = np.searchsorted(grams, h)
        k[k == len(grams)] = 0
        at = np.flatnonzero(grams[k] == h) if len(grams) else k[:0]
        doc = np.searchsorted(begins, at, side="right") - 1
        inside = at + n <= begins[doc + 1]
        yield n, at[inside], k[at[inside]], doc[inside]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int) -> Iterator[list[tuple]]:
    block, words = [], 0
    for row in benchmark.select(id_col, text_col).orderBy(id_col).toLocalIterator():
        n = len((row[1] or "").split())
        if block and words + n > block_words:
            yield block
            block, words = [], 0
        block.append((row[0], row[1]))
        words += n
    if block:
        yield block


def _seeded(docs: DataFrame, text_col: str, block: list[tuple], size: int, share: float, fewest: int, slack: float) -> Matcher | None:
    """A matcher whose seeds were chosen by the document frequencies of the whole corpus."""
    matcher = Matcher(block, size)
    if not matcher.keys:
        return None
    known = matcher.known()
    n_grams = sum(map(len, known.values()))

    def count(batches):
        hasher, total = WordHasher(), np.zeros(n_grams, np.int64)
        for b in batches:
            words, begins = hasher.texts([plain(t) for t in encoded(b.column(0))])
            base = 0
            for n, _, k, doc in hits(known, hasher, words, begins):
                np.add.at(total, np.unique(doc * len(known[n]) + k) % len(known[n]) + base, 1)
                base += len(known[n])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    found = docs.select(text_col).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toArrow()
    frequency = np.zeros(n_grams, np.int64)
    frequency[found["k"].to_numpy()] = found["n"].to_numpy()
    matcher.seed(frequency, share, fewest, slack)
    return matcher


def contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = 3, share: float = 0.25, fewest: int = 8, slack: float = 8, least: float = 0.4, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row a contaminated pair: id, item_id, score, begin and end (words of the text, end exclusive)."""
    small_batches(docs.sparkSession)
    spark, parts = docs.sparkSession, []
    schema = docs.select(F.col(id_col).alias("id")).schema.add("item_id", benchmark.schema[item_col].dataType).add("score", "double").add("begin", "long").add("end", "long")
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        matcher = _seeded(docs, text_col, block, size, share, fewest, slack)
        if matcher is None:
            continue

        def run(batches, matcher=matcher):
            hasher = WordHasher()
            for b in batches:
                rows = [(d, matcher.keys[i], *v) for d, x in enumerate(matcher.find(hasher, encoded(b.column(1)), least)) for i, v in sorted(x.items())]
                if rows:
                    d, item, score, begin, end = zip(*rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(d)), pa.array(item, item_type), pa.array(score, pa.float64()), pa.array(begin, pa.int64()), pa.array(end, pa.int64())],
                        names=["id", "item_id", "score", "begin", "end"],
                    )

        parts.append(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body")).mapInArrow(run, schema))
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = 3, share: float = 0.25, fewest: int = 8, slack: float = 8, least: float = 0.4, block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """``docs`` without the rows that match an item; columns unchanged."""
    small_batches(docs.sparkSession)
    out = docs
    for block in _blocks(benchmark, item_col, item_text_col, block_words):
        matcher = _seeded(docs, text_col, block, size, share, fewest, slack)
        if matcher is None:
            continue

        def run(batches, matcher=matcher, at=docs.columns.index(text_col)):
            hasher = WordHasher()
            for b in batches:
                clean = [not x for x in matcher.find(hasher, encoded(b.column(at)), least)]
                yield b.filter(pa.array(clean, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
