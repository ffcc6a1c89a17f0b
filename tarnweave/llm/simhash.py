"""SimHash near-dedup by meet-in-the-middle ball hashing.

A fingerprint's bit is set where more than half of the shingle hashes have it. Rows emit
all variants of their fingerprint within half the radius, rows meet on variants, and
colliding pairs are deduplicated and verified.

``simhash_components`` links single 64-bit fingerprints by Hamming distance. The members of
one variant are all within the radius of each other (at most 65 distinct fingerprints), so
linking each to the first of them loses no link's connection.

``near_duplicates`` links by the Jaccard similarity of shingle sets, at which a 64-bit
fingerprint differs in too many bits for one ball. It takes several shorter words, and
measures a ball's radius by how easily bits flip: a flip costs the square of the bit's
margin (how far the shingles are from a tie on it), and half the radius is what ``points``
variants of least cost need. Word length follows from the number of rows, so that strangers
stay rare on a variant (an eighth of a row at most, by expectation); the number of words
follows from the wanted recall of a lone pair at the least similarity, by the bivariate
normal law that margins of two such sets obey. Nothing else depends on the size.

Variants leave each input split packed, with bits of the rest of the print, each hot one once;
what meets another row whose bits are near is written as (key, cls). Rows are linked to first
rows of their variants, verified and joined into components (twice), and at last all pairs of
rows of different components on a variant are compared where they meet, and verified. Nothing is capped and no group is gathered
in one task, but for the sort that finds a variant's first row; pairs grow with the square of the unlinked rows on one variant.

Defined results: identifiers are integers; a text without words (null, empty) has
fingerprint zero and links like any other; equal texts share a fingerprint; null
identifiers are labelled like others, and a component's identifier is the least non-null
one (null if none); a bit set in exactly half of the hashes is 0, and rows that repeat or tie in all but
their identifier are one class; very long texts are hashed in pieces; an empty table gives an empty
result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, encoded, signed, small_batches, splitmix
from .components import connected

_PART = 1 << 20

#: Bytes of the signature that stands for a text where all pairs on a variant are compared.
BINS = 512


def _word_parts(text: bytes, overlap: int) -> Iterator[list[bytes]]:
    """The words of a text in pieces; each but the first begins with the last ``overlap`` words before it."""
    if len(text) <= _PART:
        yield text.split()
        return
    at, carry, tail = 0, [], b""
    while at < len(text):
        piece = tail + text[at : at + _PART]
        at += _PART
        found = piece.split()
        tail = b""
        if at < len(text) and found and not piece[-1:].isspace():
            tail = found.pop()
        yield carry + found
        carry = (carry + found)[-overlap:] if overlap else []
    if tail:
        yield carry + [tail]


def shingle_hashes(text: bytes, size: int, seed: int = 42) -> Iterator[np.ndarray]:
    """XXH64 of every run of ``size`` words (of the whole sequence if shorter), repeats included, in pieces."""
    digest, seen, first = xxhash.xxh64_intdigest, False, []
    for part in _word_parts(text, size - 1):
        runs = zip(*(part[i:] for i in range(size)))
        got = np.fromiter((digest(b" ".join(x), seed) for x in runs), np.uint64)
        if len(got):
            seen = True
            yield got
        elif not seen:
            first = part
    if not seen and first:
        yield np.array([digest(b" ".join(first), seed)], np.uint64)


def _distinct(pieces: Iterator[np.ndarray]) -> Iterator[np.ndarray]:
    """The hashes once each; they are held, 8 bytes a distinct shingle of the one text."""
    seen, new, size = np.zeros(0, np.uint64), [], 0
    for hashes in pieces:
        new.append(np.unique(hashes))
        size += len(new[-1])
        if size > len(seen):
            seen, new, size = np.unique(np.concatenate((seen, *new))), [], 0
    yield np.unique(np.concatenate((seen, *new))) if new else seen


def _bit_counts(pieces: Iterator[np.ndarray], chunks: int) -> tuple[np.ndarray, int]:
    """How many hashes have each bit, and how many there are; each chunk of 64 bits after the first mixes the hashes again."""
    counts, n = np.zeros((chunks, 64), np.int64), 0
    for hashes in pieces:
        n += len(hashes)
        for at in range(0, len(hashes), 1 << 14):
            h = hashes[at : at + (1 << 14)]
            for c in range(chunks):
                mixed = h if c == 0 else splitmix(h + np.uint64(c))
                bits = np.unpackbits(mixed.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts[c] += bits.sum(axis=0, dtype=np.int64)
    return counts, n


def fingerprint(text: bytes, size: int, seed: int = 42) -> int:
    """The 64-bit fingerprint, as a signed integer; repeated shingles count."""
    counts, n = _bit_counts(shingle_hashes(text.lower(), size, seed), 1)
    return int(np.packbits(counts[0] > n / 2, bitorder="little").view("<i8")[0])


def describe(text: bytes, size: int, words: int, word_bits: int, sketch: int, weak: int = 8, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Print (64-bit integers), flips, sketch and bins of a text, each distinct shingle counted once.

    Flips: for each word its ``weak`` bits of least margin (bytes), then their margins in
    units of 1/64 of the square root of the number of shingles (bytes, 255 at most). The
    sketch is the ``sketch`` least of the shingles' 31-bit hashes. Bins deal the hashes into
    BINS and keep a byte of the least one in each (0 in an empty bin).
    """
    (hashes,) = _distinct(shingle_hashes(text.lower(), size, seed))
    chunks = math.ceil(words * word_bits / 64)
    counts, n = _bit_counts(iter([hashes]), chunks)
    margin = np.minimum(np.abs(2 * counts - n) * (64 / math.sqrt(max(1, n))), 255).astype(np.uint8).reshape(-1)[: words * word_bits].reshape(words, word_bits)
    bits = np.argsort(margin, axis=1, kind="stable")[:, :weak].astype(np.uint8)
    # sorted by the whole hash, so by its upper 31 bits too
    short = (hashes >> np.uint64(33)).astype(np.int32)
    if len(short):
        short = short[np.concatenate(([True], short[1:] != short[:-1]))][:sketch]
    flips = np.concatenate((bits, np.take_along_axis(margin, bits.astype(np.int64), axis=1)))
    bins = np.zeros(BINS, np.uint8)
    which, first = np.unique(hashes % np.uint64(BINS), return_index=True)
    bins[which.astype(np.int64)] = (hashes[first] // np.uint64(BINS)) % np.uint64(255) + np.uint64(1)
    return np.packbits(counts > n / 2, axis=1, bitorder="little").view("<i8").reshape(-1), flips, short, bins


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("tid"), F.col(text_col).alias("body"))


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """id, tid (hash of the text), cls (fingerprint), one row an input row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([fingerprint(t, size) for t in encoded(b.column(2))], pa.int64())], names=["id", "tid", "cls"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, tid long, cls long")


def prints(docs: DataFrame, id_col: str, text_col: str, size: int, words: int, word_bits: int, sketch: int) -> DataFrame:
    """id, tid, fp, flips, sk, bins (see ``describe``), one row an input row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            fps, flips, sketches, bins = zip(*(describe(t, size, words, word_bits, sketch) for t in encoded(b.column(2)))) if b.num_rows else ((), (), (), ())
            packed = [pa.array([x.tobytes() for x in column], pa.binary()) for column in (flips, bins)]
            columns = [pa.array(fps, pa.list_(pa.int64())), packed[0], pa.array(sketches, pa.list_(pa.int32())), packed[1]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["id", "tid", "fp", "flips", "sk", "bins"])

    return _rows(docs, id_col, text_col).mapInArrow(run, "id long, tid long, fp array<long>, flips binary, sk array<int>, bins binary")


def _links(classes: DataFrame, radius: int) -> DataFrame:
    """(a, b): verified pairs of 64-bit fingerprints (cls) that meet on a variant with one other bit or none; each is linked to a variant's first."""
    if radius not in (1, 2):
        raise ValueError("a radius of 1 or 2 bits is supported")
    flips = F.expr("transform(sequence(-1, 63), i -> CASE WHEN i < 0 THEN cls ELSE cls ^ shiftleft(1L, i) END)")
    balls = classes.select("cls", F.explode(flips).alias("v"))
    first = F.first("cls").over(Window.partitionBy("v").orderBy("cls").rowsBetween(Window.unboundedPreceding, 0))
    pairs = balls.select(F.col("cls").alias("a"), first.alias("b")).where("a <> b").distinct()
    return pairs.where(F.expr(f"bit_count(a ^ b) <= {radius}"))


def _least() -> "F.Column":
    return F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("tid").alias("tid")))


def _owned(rows: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """``rows`` (id, tid, cls) with owner: identifier and text hash of the first row of the component of cls."""
    roots = scratch.cut(connected(links, scratch))
    named = rows.groupBy("cls").agg(_least().alias("least")).join(roots.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = scratch.cut(named)
    # a table of its own, so that the join below can be split where one component is large
    owners = scratch.cut(named.groupBy("root").agg(F.min("least").alias("owner")))
    return rows.join(named.select("cls", "root").join(owners, "root").select("cls", "owner"), "cls")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, radius: int = 2) -> DataFrame:
    """One row an input row: id, tid, cls (its fingerprint), component_id, owner (identifier and text hash of the component's first row)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.cut(fingerprints(docs, id_col, text_col, size))
    labelled = _owned(rows, _links(rows.select("cls").distinct(), radius), scratch)
    return labelled.select("id", "tid", "cls", F.col("owner.id").alias("component_id"), "owner")


@functools.cache
def meeting(word_bits: int, similarity: float, points: int, weak: int = 8) -> float:
    """Probability that the balls of one word meet for two equally large shingle sets of that Jaccard similarity.

    Margins of the two are normal with the sets' cosine 2s / (1 + s) as correlation; 8,000
    seeded draws (a standard error of half a hundredth).
    """
    rng, cos, n = np.random.default_rng(3), 2 * similarity / (1 + similarity), 8000
    x = rng.standard_normal((n, word_bits))
    y = cos * x + math.sqrt(1 - cos * cos) * rng.standard_normal((n, word_bits))
    keys = []
    for z in (x, y):
        bits = np.argsort(np.abs(z), axis=1)[:, :weak]
        word = (z > 0) @ (np.uint64(1) << np.arange(word_bits, dtype=np.uint64))
        keys.append(ball(word, bits.astype(np.uint8), (np.take_along_axis(np.abs(z), bits, axis=1) * 64).clip(0, 255).astype(np.uint8), points))
    return float(np.mean([not set(p).isdisjoint(q) for p, q in zip(keys[0].tolist(), keys[1].tolist())]))


def net(rows: int, similarity: float, recall: float, points: int = 32) -> tuple[int, int]:
    """Words and bits a word, for that many rows: a lone pair of that similarity meets with probability ``recall``, and at most an eighth of a stranger is on a variant."""
    word_bits = min(52, max(28, math.ceil(math.log2(max(1, rows) * points)) + 3))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - meeting(word_bits, similarity, points)))), word_bits


@functools.cache
def _subsets(weak: int) -> np.ndarray:
    return (np.arange(1 << weak)[:, None] >> np.arange(weak) & 1).astype(np.uint8)


def ball(word: np.ndarray, bits: np.ndarray, margins: np.ndarray, points: int) -> np.ndarray:
    """The ``points`` variants of each word whose flips of the given bits cost least (squares of their margins, summed)."""
    subsets = _subsets(bits.shape[1])
    cost = (margins.astype(np.float32) ** 2) @ subsets.T.astype(np.float32)
    pick = np.argpartition(cost, points - 1, axis=1)[:, :points]
    flips = np.zeros(pick.shape, np.uint64)
    for i in range(bits.shape[1]):
        flips |= subsets[:, i].astype(np.uint64)[pick] << bits[:, i : i + 1].astype(np.uint64)
    return word[:, None] ^ flips


def _chance(similarity: float, bits: int, slack: float) -> int:
    """Differing bits of that many, expected at a similarity (each differs with probability angle / pi), plus ``slack`` standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(bits * p + slack * math.sqrt(bits * p * (1 - p)))


def _balls(fp: np.ndarray, flips: np.ndarray, words: int, word_bits: int, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Variants of all words of prints (a row each), numbered by word; and for each word, at the upper end of 64 bits, as many other bits of the print as are free there."""
    n, weak = len(fp), flips.shape[1] // (2 * words)
    every = np.unpackbits(np.ascontiguousarray(fp).view(np.uint8), axis=1, bitorder="little")
    word = every[:, : words * word_bits].reshape(n * words, word_bits) @ (np.uint64(1) << np.arange(word_bits, dtype=np.uint64))
    flips = flips.reshape(n, 2, words, weak)
    out = ball(word, flips[:, 0].reshape(-1, weak), flips[:, 1].reshape(-1, weak), points).reshape(n, words, points)
    out |= (np.arange(words, dtype=np.uint64) << np.uint64(word_bits))[None, :, None]
    free = 64 - _width(words, word_bits)
    at = (np.arange(words)[:, None] * word_bits + word_bits + np.arange(free)) % every.shape[1]
    check = every[:, at] @ (np.uint64(1) << np.arange(64 - free, 64, dtype=np.uint64))
    return out, check


def _width(words: int, word_bits: int) -> int:
    return word_bits + (words - 1).bit_length()


def _company(key: np.ndarray, check: np.ndarray, limit: int) -> np.ndarray:
    """Of entries in order of key: which have another of their key whose check bits are near; all of a key with many entries."""
    keep = np.zeros(len(key), bool)
    for d in range(1, 10):
        same = key[d:] == key[:-d]
        if not same.any():
            return keep
        near = same & (np.bitwise_count(check[d:] ^ check[:-d]) <= limit)
        keep[d:] |= near
        keep[:-d] |= near
    group = np.cumsum(np.concatenate(([0], key[1:] != key[:-1])))
    return keep | (np.bincount(group)[group] > 9)


_PACKED = "bucket int, met boolean, entries binary"


def _sorted(entries: np.ndarray, mask: np.uint64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, check bits and cls of distinct entries, in order of key and cls."""
    key, cls = entries[:, 0].view(np.uint64) & mask, entries[:, 1]
    order = np.lexsort((cls, key))
    key, cls, check = key[order], cls[order], (entries[:, 0].view(np.uint64) & ~mask)[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    return key[fresh], check[fresh], cls[fresh]


def _pack(words: int, word_bits: int, points: int, buckets: int, limit: int, most: int = 1 << 20):
    """Rows (cls, fp, flips) to packed (key with check bits, cls) entries by bucket of the key. What meets inside a split is known to (``met``); of those, one entry a key goes on."""
    mask = np.uint64((1 << _width(words, word_bits)) - 1)

    def flush(parts: list):
        key, check, cls = _sorted(np.concatenate(parts), mask)
        company = _company(key, check, limit)
        lead = np.zeros(len(key), bool)  # the first of a key that has company
        at = np.flatnonzero(company)
        lead[at[np.unique(key[at], return_index=True)[1]]] = True
        for met, chosen, by in ((False, lead | ~company, key), (True, company, cls.view(np.uint64))):
            bucket = (splitmix(by[chosen]) % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            entries = np.stack(((key[chosen] if met else key[chosen] | check[chosen]).view(np.int64), cls[chosen]), axis=1)[order]
            which, at = np.unique(bucket[order], return_index=True)
            blobs = [x.tobytes() for x in np.split(entries, at[1:])] if len(which) else []
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int32()), pa.array([met] * len(which), pa.bool_()), pa.array(blobs, pa.binary())], names=["bucket", "met", "entries"])

    def run(batches):
        parts, size = [], 0
        for b in batches:
            if not b.num_rows:
                continue
            fp = np.array(b.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(b.num_rows, -1)
            flips = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
            found, check = _balls(fp, flips, words, word_bits, points)
            owners = np.repeat(b.column(0).to_numpy(), words * points)
            parts.append(np.stack(((found | check[:, :, None]).reshape(-1).view(np.int64), owners), axis=1))
            size += len(owners)
            if size >= most:
                yield from flush(parts)
                parts, size = [], 0
        if size:
            yield from flush(parts)

    return run


def _meet(words: int, word_bits: int, limit: int):
    """Packed entries in order of bucket to rows (key, cls) of what has company on its key."""
    mask = np.uint64((1 << _width(words, word_bits)) - 1)

    def rows(key: np.ndarray, cls: np.ndarray):
        for at in range(0, len(key), 1 << 18):
            yield pa.RecordBatch.from_arrays([pa.array(key[at : at + (1 << 18)].view(np.int64)), pa.array(cls[at : at + (1 << 18)])], names=["key", "cls"])

    def close(blobs: list):
        key, check, cls = _sorted(np.frombuffer(b"".join(blobs), np.int64).reshape(-1, 2), mask)
        company = _company(key, check, limit)
        yield from rows(key[company], cls[company])

    def run(batches):
        last, blobs = None, []
        for b in batches:
            for bucket, met, entries in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                if met:
                    known = np.frombuffer(entries, np.int64).reshape(-1, 2)
                    yield from rows(known[:, 0].copy(), known[:, 1].copy())
                    continue
                if bucket != last and blobs:
                    yield from close(blobs)
                    blobs = []
                last = bucket
                blobs.append(entries)
        if blobs:
            yield from close(blobs)

    return run


def _near(pairs: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """The pairs whose whole prints differ in at most ``limit`` bits."""
    left, right = classes.select(F.col("cls").alias("a"), F.col("fp").alias("x")), classes.select(F.col("cls").alias("b"), F.col("fp").alias("y"))
    return pairs.join(left, "a").join(right, "b").where(_distance() <= limit).select("a", "b")


def _distance() -> "F.Column":
    return F.expr("aggregate(zip_with(x, y, (p, q) -> bit_count(p ^ q)), 0, (s, n) -> s + n)")


def _similar(pairs: DataFrame, classes: DataFrame, similarity: float, sketch: int) -> DataFrame:
    """Pairs whose shingle sets have that Jaccard similarity: among the least hashes of the union, the share that both have.

    Exact for sets of up to ``sketch`` shingles together, else an estimate with a standard
    deviation of sqrt(s (1 - s) / sketch).
    """
    left, right = classes.select(F.col("cls").alias("c"), F.col("sk").alias("x")), classes.select(F.col("cls").alias("d"), F.col("sk").alias("y"))
    both = pairs.select(F.col("a").alias("c"), F.col("b").alias("d")).join(left, "c").join(right, "d")
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, sketch)
    both = both.select("c", "d", "x", "y", union.alias("u"))
    share = F.size(F.array_intersect("u", F.array_intersect("x", "y"))) / F.greatest(F.size("u"), F.lit(1))
    return both.where((share >= similarity) | (F.size("u") == 0)).select(F.col("c").alias("a"), F.col("d").alias("b"))


def _mixed(met: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, cls, comp, n) of the keys on which rows of several components meet; n rows on each."""
    named = met.select("key", "cls").join(found.select(F.col("node").alias("cls"), "root"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("comp"))
    named = scratch.cut(named.distinct())
    keys = named.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("n")).where("low <> high")
    return scratch.cut(named.join(scratch.cut(keys.select("key", "n")), "key"))


def _star(rows: DataFrame, turn: int, most: int = 8) -> DataFrame:
    """(a, b): rows (key, cls, comp) with heads of their keys that are in other components, each with the ``most`` it has most keys of.

    At the first turn the head is the least row, the same on many keys; later one drawn by key.
    """
    order = F.col("cls") if turn == 0 else F.xxhash64("cls", "key", F.lit(turn))
    first = F.first(F.struct("comp", "cls")).over(Window.partitionBy("key").orderBy(order, "cls").rowsBetween(Window.unboundedPreceding, 0))
    # a row has one head a key: no more pairs than rows
    pairs = rows.withColumn("head", first).where("comp <> head.comp").select(F.col("cls").alias("a"), F.col("head.cls").alias("b"))
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    # a row has at most as many heads as keys
    chosen = counted.groupBy("a").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "b")), asc=False), 1, most).alias("heads"))
    return chosen.select("a", F.explode("heads.b").alias("b"))


def _compare(similarity: float, slack: float, most: int = 1 << 13):
    """Rows (cls, comp, bins, key, i, j) in order of key, i, j to the pairs (a, b) of different components there whose bins agree with that similarity, less ``slack`` standard deviations."""

    def pairs(cls: np.ndarray, comp: np.ndarray, bins: np.ndarray, group: np.ndarray):
        found, at, d = [], np.arange(len(cls)), 0
        while True:
            d += 1
            at = at[at + d < len(cls)]
            at = at[group[at] == group[at + d]]
            if not len(at):
                break
            for k in range(0, len(at), most):
                x = at[k : k + most]
                x = x[comp[x] != comp[x + d]]
                p, q = bins[x], bins[x + d]
                either = np.count_nonzero(p | q, axis=1)
                same = np.count_nonzero((p == q) & (p != 0), axis=1)
                # bins sample the union without replacement; how many of it they hold follows from how many are filled
                union = -BINS * np.log1p(-np.minimum(either, BINS - 0.5) / BINS)
                rest = np.maximum(1 - either / np.maximum(union, 1), 0.05)
                x = x[same >= either * similarity - slack * np.sqrt(either * similarity * (1 - similarity) * rest)]
                found.append(np.stack((np.minimum(cls[x], cls[x + d]), np.maximum(cls[x], cls[x + d])), axis=1))
        out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        if len(out):
            yield pa.RecordBatch.from_arrays([pa.array(out[:, 0].copy()), pa.array(out[:, 1].copy())], names=["a", "b"])

    def run(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            columns = [b.column(k).to_numpy() for k in (0, 1, 3, 4, 5)]
            columns.append(np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, BINS))
            held = columns if held is None else [np.concatenate(x) for x in zip(held, columns)]
            if len(held[0]) < most:
                continue
            cls, comp, key, i, j, bins = held
            step = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
            if step.any():  # the last group may go on
                end = int(np.flatnonzero(step)[-1]) + 1
                yield from pairs(cls[:end], comp[:end], bins[:end], np.concatenate(([0], np.cumsum(step)))[:end])
                held = [x[end:] for x in held]
        if held is not None:
            cls, comp, key, i, j, bins = held
            yield from pairs(cls, comp, bins, np.concatenate(([0], np.cumsum((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])))))

    return run


def _spread(block: int):
    """Rows (cls, comp, bins, at: array of (key, n)) to rows (cls, comp, bins, key, i, j): one a key, or several where n rows make several blocks."""

    def run(batches, step: int = 1 << 14):
        for b in batches:
            at = b.column(3)
            source = np.repeat(np.arange(b.num_rows), np.diff(at.offsets.to_numpy()))
            key, n = at.flatten().field(0).to_numpy(), at.flatten().field(1).to_numpy()
            blocks = -(-n // block)
            own = (splitmix(b.column(0).to_numpy().view(np.uint64)[source]) % blocks.astype(np.uint64)).astype(np.int64)
            # row of block k in all pairs of blocks with k
            each = np.repeat(np.arange(len(key)), blocks)
            k = np.arange(len(each)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            i, j = np.minimum(own[each], k), np.maximum(own[each], k)
            for s in range(0, len(each), step):
                e, take = each[s : s + step], pa.array(source[each[s : s + step]])
                columns = [b.column(c).take(take) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(key[e]), pa.array(i[s : s + step]), pa.array(j[s : s + step])], names=["cls", "comp", "bins", "key", "i", "j"])

    return run


def _cross_pairs(mixed: DataFrame, classes: DataFrame, similarity: float, slack: float, block: int = 2048) -> DataFrame:
    """(a, b): on each variant all pairs of rows of different components, those whose bins are near enough. A variant with many rows is dealt out in pairs of blocks."""
    rows = mixed.groupBy("cls", "comp").agg(F.collect_list(F.struct("key", "n")).alias("at")).join(classes.select("cls", "bins"), "cls").select("cls", "comp", "bins", "at")
    each = rows.mapInArrow(_spread(block), "cls long, comp long, bins binary, key long, i long, j long")
    dealt = each.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(_compare(similarity, slack), "a long, b long").distinct()


def _wide_links(classes: DataFrame, words: int, word_bits: int, points: int, similarity: float, slack: float, sketch: int, scratch: Scratch, rows: int) -> DataFrame:
    """(a, b): links of ``classes`` (cls, fp, flips, sk, bins), enough of them to connect what all verified pairs that meet on a variant connect."""
    spark = classes.sparkSession
    # a bucket holds some 16 MB
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows * words * points / (1 << 20)))
    near = _chance(similarity, 64 - _width(words, word_bits), slack)
    packed = classes.select("cls", "fp", "flips").mapInArrow(_pack(words, word_bits, points, buckets, near), _PACKED)
    met = scratch.cut(packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_meet(words, word_bits, near), "key long, cls long"))
    limit = _chance(similarity, 64 * math.ceil(words * word_bits / 64), slack)
    # large groups first become few components, by pairs with the first rows of variants; copies meet on nearly every word,
    # so a quarter of the words brings most of them together and the second turn sees what is left on all of them
    found = scratch.cut(spark.createDataFrame([], "node long, root long"))
    for turn in range(2):
        mixed = _mixed(met, found, scratch)
        some = mixed.where(F.shiftrightunsigned("key", word_bits) < max(1, words // 4)) if turn == 0 else mixed
        links = _similar(_near(_star(some, turn), classes, limit), classes, similarity, sketch)
        found = scratch.cut(connected(found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links), scratch))
        met = mixed
    # then all pairs of rows of different components
    cross = _cross_pairs(_mixed(met, found, scratch), classes, similarity, slack)
    return found.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(_similar(cross, classes, similarity, sketch))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, recall: float = 0.98, points: int = 32, slack: float = 2.75, sketch: int = 512,
) -> DataFrame:
    """One row an input row: id, tid, cls, owner (identifier and text hash of the first row of its group).

    Pairs that meet go on while other bits of their prints, then bytes of their bins, differ by no
    more than expected at ``similarity`` plus ``slack`` standard deviations; then their
    similarity is taken from the least ``sketch`` shingle hashes.
    """
    n = docs.count()
    words, word_bits = net(n, similarity, recall, points)
    scratch = Scratch(docs.sparkSession, "near")
    # rows of one print are one class only if their sketches agree too
    rows = scratch.cut(prints(docs, id_col, text_col, size, words, word_bits, sketch).withColumn("cls", F.xxhash64("fp", "sk")))
    classes = rows.groupBy("cls").agg(*[F.first(c).alias(c) for c in ("fp", "flips", "sk", "bins")])
    classes = scratch.cut(classes)
    links = _wide_links(classes, words, word_bits, points, similarity, slack, sketch, scratch, n)
    return _owned(rows.select("id", "tid", "cls"), links, scratch)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, similarity: float = 0.8, recall: float = 0.98, points: int = 32, slack: float = 2.75, sketch: int = 512) -> DataFrame:
    """``docs`` with one row of each group of ``near_duplicates``, the one with the least identifier; columns unchanged."""
    marked = near_duplicates(docs, id_col, text_col, size, similarity, recall, points, slack, sketch)
    lost = marked.where(~(F.col("id").eqNullSafe(F.col("owner.id")) & (F.col("tid") == F.col("owner.tid")))).select("id", "tid").distinct()
    same = docs[id_col].cast("long").eqNullSafe(lost["id"]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == lost["tid"])
    return docs.join(lost, same, "left_anti")
