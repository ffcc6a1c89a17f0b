import math
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tarnweave.llm import simhash as S
from tarnweave.llm.components import connected
from tarnweave.plans.lineage import Scratch


def slow_print(text, size=3):
    w = (text or "").encode().lower().split()
    runs = [b" ".join(w[i : i + size]) for i in range(len(w) - size + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) > len(h) / 2)


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_fingerprints(monkeypatch):
    rng = random.Random(1)
    texts = ["", "a", "A b", "É Ü x y z", *(" ".join(rng.choice("abcDEFéß") * rng.randint(1, 4) for _ in range(rng.randint(3, 90))) for _ in range(20))]
    for part in (1 << 20, 7):  # 7: read in pieces
        monkeypatch.setattr(S, "_PART", part)
        for t in texts:
            assert S.fingerprint(t.encode(), 3) & (1 << 64) - 1 == slow_print(t)


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    for n, m in ((60, 40), (200, 199), (30, 0)):
        pairs = [(i, i + 1) for i in range(m)] if m == 199 else [(rng.randrange(n), rng.randrange(n)) for _ in range(m)]
        got = connected(spark.createDataFrame(pairs, "a long, b long"), Scratch(spark, "test")).collect()
        want = roots(n, pairs)
        assert {r.node: r.root for r in got} == {i: want[i] for p in pairs if p[0] != p[1] for i in p}
        assert len(got) == len({r.node for r in got})


def test_links_against_all_pairs(spark, monkeypatch):
    rng = random.Random(6)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = base + [b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64) for b in base for _ in range(4)] + [b ^ 7 for b in base]
    rows = [(i, i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "id long, tid long, cls long")
    monkeypatch.setattr(S, "fingerprints", lambda *a: prints)
    docs = spark.createDataFrame([], "doc_id long, text string")
    got = {r.id: r.component_id for r in S.simhash_components(docs).collect()}
    pairs = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 2]
    assert got == dict(enumerate(roots(len(values), pairs)))


def test_near_duplicates(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, k = [], 0
    for g in range(30):
        text = [word() for _ in range(400)]
        for c in range(3):
            copy = list(text)
            for _ in range(c * 2):  # similarity of about 0.95 and 0.9
                copy[rng.randrange(400)] = word()
            rows.append((k, " ".join(copy), "z"))
            k += 1
    half = [word() for _ in range(200)]
    rows += [(1000, " ".join(half + [word() for _ in range(200)]), "z"), (1001, " ".join(half + [word() for _ in range(200)]), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    kept = S.drop_near_duplicates(docs)
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns
    assert {3 * g for g in range(30)} | {1000, 1001} <= ids
    assert len(ids) <= 32 + 1  # at least 59 of the 60 near copies go


def edited(rng, words, similarity, word):
    """``words`` with single words replaced until the shingle sets have about that similarity, and the exact one."""
    runs = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    out, own = list(words), runs(words)
    while True:
        new = list(out)
        new[rng.randrange(len(new))] = word()
        other = runs(new)
        if len(own & other) / len(own | other) < similarity:
            return out, len(own & runs(out)) / len(own | runs(out))
        out = new


def isolated_pairs(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows, found = [], []
    for k in range(n):
        text = [word() for _ in range(rng.randint(300, 450))]
        other, s = edited(rng, text, 0.8 + 0.15 * k / n, word)
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(other))]
        found.append(s)
    return rows, found


BANDS = ((0.8, 0.82), (0.82, 0.85), (0.85, 0.9), (0.9, 1.0))


def recalls(spark, rows, found):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in S.drop_near_duplicates(docs).select("doc_id").collect()}
    assert {2 * k for k in range(len(found))} <= kept and {r[0] for r in rows[2 * len(found) :]} <= kept
    for low, high in BANDS:
        own = [2 * k + 1 not in kept for k, s in enumerate(found) if low <= s < high]
        yield sum(own) / len(own)


def test_recall_of_isolated_pairs(spark):
    rows, found = isolated_pairs(random.Random(21), 600)
    got = list(recalls(spark, rows, found))
    assert min(got) >= 0.95, got


def test_recall_among_strangers(spark, monkeypatch):
    """Words so short that a variant holds some five rows that have nothing to do with one another."""
    rng = random.Random(22)
    rows, found = isolated_pairs(rng, 300)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows += [(10_000 + k, " ".join(word() for _ in range(60))) for k in range(1500)]
    bits = 14
    monkeypatch.setattr(S, "net", lambda *a: (math.ceil(math.log(0.02) / math.log(1 - S.meeting(bits, 0.8, 32))), bits))
    assert len(rows) * 32 / 2**bits > 4
    got = list(recalls(spark, rows, found))
    assert min(got) >= 0.95, got


def test_no_link_between_pairs_that_meet_is_lost(spark):
    """Rows of few components against all pairs of rows on the same variants."""
    rng = random.Random(12)
    words, bits, points = 4, 14, 16
    texts = []
    for g in range(40):
        base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
        for c in range(g % 5 + 1):  # chains: each near the one before it only
            texts.append(" ".join(base))
            for _ in range(2):
                base[rng.randrange(120)] = f"w{rng.randrange(10**6)}"
    rng.shuffle(texts)
    parts = [S.describe(t.encode(), 5, words, bits, 512) for t in texts]
    classes = spark.createDataFrame([(i, fp.tolist(), bytearray(fl.tobytes()), sk.tolist(), bytearray(bins.tobytes())) for i, (fp, fl, sk, bins) in enumerate(parts)], "cls long, fp array<long>, flips binary, sk array<int>, bins binary")
    balls = [set(S._balls(fp[None], fl.reshape(1, -1), words, bits, points)[0].reshape(-1).tolist()) for fp, fl, _, _ in parts]
    near = lambda i, j: len(set(parts[i][2]) & set(parts[j][2])) / len(set(parts[i][2]) | set(parts[j][2])) >= 0.8
    met = [(i, j) for i in range(len(texts)) for j in range(i) if balls[i] & balls[j]]
    pairs = [(i, j) for i, j in met if near(i, j)]
    assert len(pairs) > 40 and len(met) > 3 * len(pairs)
    scratch = Scratch(spark, "test")
    got = {r.node: r.root for r in connected(S._wide_links(classes, words, bits, points, 0.8, 3.5, 512, scratch, len(texts)), scratch).collect()}
    assert [got.get(i, i) for i in range(len(texts))] == roots(len(texts), pairs)


def test_blocks_of_a_variant(spark):
    """All pairs of a variant with more rows than a block, whatever the buffer."""
    rng = np.random.default_rng(4)
    base = rng.integers(1, 256, (6, S.BINS), dtype=np.uint8)
    rows = [(k, k % 7, bytearray(np.where(rng.random(S.BINS) < 0.9, base[k % 6], rng.integers(1, 256, S.BINS)).astype(np.uint8).tobytes())) for k in range(150)]
    classes = spark.createDataFrame([(c, b) for c, _, b in rows], "cls long, bins binary")
    mixed = spark.createDataFrame([(key, c, p, n) for c, p, _ in rows for key, n in ((1, 150), (2 + c % 2, 75))], "key long, cls long, comp long, n long")
    got = {tuple(r) for r in S._cross_pairs(mixed, classes, 0.8, 3.0, block=20).collect()}
    rest = 1 - 1 / math.log(2 * S.BINS)  # all bins are filled
    same = lambda x, y: sum(p == q for p, q in zip(x, y)) >= S.BINS * 0.8 - 3 * math.sqrt(S.BINS * 0.16 * rest)
    want = {(a, b) for a, p, x in rows for b, q, y in rows if a < b and p != q and same(x, y)}
    assert got == want and len(want) > 300
    small = S._compare(0.8, 3.0, most=16)
    table = sorted((1, 0, 0, c, p, b) for c, p, b in rows)
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*[(c, p, bytes(b), key, i, j) for key, i, j, c, p, b in table[k : k + 10]])], names=list("abcdef")) for k in range(0, 150, 10)]
    assert {(a, b) for out in small(iter(batches)) for a, b in zip(*(x.to_pylist() for x in out.columns))} == want


def test_company():
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 60, 150)).astype(np.uint64)
    key[100:] = 77  # a key of many entries
    check = rng.integers(0, 1 << 12, 150).astype(np.uint64)
    got = S._company(key, check, 4)
    groups = {k: np.flatnonzero(key == k) for k in set(key.tolist())}
    want = [len(groups[int(k)]) > 9 or any(i != j and int(check[i] ^ check[j]).bit_count() <= 4 for j in groups[int(k)]) for i, k in enumerate(key)]
    assert got.tolist() == want and 0 < sum(want[:100]) < 100
    assert S._company(key[:0], check[:0], 4).tolist() == [] and S._company(key[:1], check[:1], 4).tolist() == [False]


def test_balls_are_the_nearest_variants():
    word, bits, margins = np.array([0b1010], np.uint64), np.array([[0, 2, 3]], np.uint8), np.array([[1, 3, 10]], np.uint8)
    assert sorted(S.ball(word, bits, margins, 4)[0].tolist()) == sorted([0b1010, 0b1011, 0b1110, 0b1111])
    for n in (10, 10**5, 10**8):
        words, size = S.net(n, 0.8, 0.98)
        assert n * 32 / 2**size <= 1 / 8 and 1 - (1 - S.meeting(size, 0.8, 32)) ** words >= 0.98


def test_repeats_neither_join_nor_part_texts(spark):
    rng = random.Random(14)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    rows = [(d, "a " * 200 + " ".join(word() for _ in range(100))) for d in range(12)]  # one shingle is over half of each
    for d in range(20, 40, 2):
        lines = [" ".join(word() for _ in range(5)) for _ in range(60)]
        rows.append((d, "\n".join(lines)))
        rows.append((d + 1, "\n".join(lines + [x for x in lines[:3] for _ in range(60)])))  # nearly the same set of shingles
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert {r.doc_id for r in S.drop_near_duplicates(docs).collect()} == {*range(12), *range(20, 40, 2)}


def test_distinct_shingles_in_pieces(monkeypatch):
    rng = random.Random(15)
    text = " ".join(rng.choice("abcd") for _ in range(3000)).encode()
    fp, flips, sketch, bins = S.describe(text, 5, 7, 28, 64)
    hashes = {int(h) for part in S.shingle_hashes(text, 5) for h in part}
    assert sketch.tolist() == sorted({h >> 33 for h in hashes})[:64]
    counts = [sum(h >> b & 1 for h in hashes) for b in range(64)]
    assert int(fp[0]) & (1 << 64) - 1 == sum(1 << b for b in range(64) if counts[b] > len(hashes) / 2)
    margins = [abs(2 * c - len(hashes)) for c in counts[:28]]
    assert sorted(margins[b] for b in flips[0].tolist()) == sorted(margins)[:8]
    assert bins.tolist() == [min((h for h in hashes if h % 512 == k), default=0) // 512 % 255 + 1 if any(h % 512 == k for h in hashes) else 0 for k in range(512)]
    monkeypatch.setattr(S, "_PART", 50)
    again = S.describe(text, 5, 7, 28, 64)
    assert all((x == y).all() for x, y in zip((fp, flips, sketch, bins), again))


def test_sketches(spark):
    rng = random.Random(3)
    sets = [set(rng.sample(range(3000), n)) for n in (40, 500, 900)] + [set()]
    sets += [set(list(s)[: len(s) * 9 // 10]) | set(rng.sample(range(4000, 9000), len(s) // 50)) for s in sets[:3]]
    spread = {x: rng.getrandbits(31) for s in sets for x in s}
    classes = spark.createDataFrame([(i, sorted(spread[x] for x in s)[:512]) for i, s in enumerate(sets)], "cls long, sk array<int>")
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)] + [(3, 3)]
    got = {tuple(r) for r in S._similar(spark.createDataFrame(pairs, "a long, b long"), classes, 0.8, 512).collect()}
    assert got == {(i, j) for i, j in pairs if not sets[i] | sets[j] or len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.8} and len(got) == 4


def test_edges(spark, nasty, nothing):
    got = S.simhash_components(nasty).collect()
    assert len(got) == nasty.count()
    assert {(r.cls, r.component_id) for r in got if r.id in (1, 2, 3, 9)} == {(0, 1)}
    assert {r.component_id for r in got if r.id == 5} == {5}
    kept = S.drop_near_duplicates(nasty).collect()
    assert sum(r.text == "same text here again" for r in kept) == 1 and sum(r.doc_id in (1, 2, 3, 9) for r in kept) == 1
    assert S.simhash_components(nothing).count() == 0 and S.drop_near_duplicates(nothing).count() == 0


def test_large_group_meets_on_a_part_of_its_words_first(spark, monkeypatch):
    """A group of near copies is joined to first rows on a quarter of its words; what that doesn't connect is left to the later turns."""
    rng, star, seen = np.random.default_rng(8), S._star, []
    base = [f"w{x}" for x in rng.integers(0, 10**6, 400)]
    texts = []
    for i in range(120):
        words = list(base)
        words[int(rng.integers(400))] = f"own{i}"
        texts.append((i, " ".join(words)))
    docs = spark.createDataFrame(texts, "doc_id long, text string")

    def counted(rows, *rest):
        seen.append(rows.count())
        return star(rows, *rest)

    whole = S._mixed
    monkeypatch.setattr(S, "_mixed", lambda *a: sizes.append((out := whole(*a)).count()) or out)
    monkeypatch.setattr(S, "_star", counted)
    sizes: list = []
    owners = S.near_duplicates(docs).select("owner.id").distinct().collect()
    assert [r[0] for r in owners] == [0]
    assert seen[0] < sizes[0] / 3 and seen[1] < sizes[0] / 3


@pytest.mark.parametrize("turn", [0, 1])
def test_star_has_one_head_a_key_and_no_join(spark, turn):
    """A key of n rows gives n - 1 pairs at most, by one shuffle of the rows; heads are those of a plain count."""
    from tarnweave.llm.simhash import _star

    rows = [(k, c, min(c, 40)) for k in range(6) for c in range(10 * k, 60)]
    df = spark.createDataFrame(rows, "key long, cls long, comp long")
    order = {(r.key, r.cls): r.o for r in df.select("key", "cls", F.xxhash64("cls", "key", F.lit(turn)).alias("o")).collect()}
    want = {}
    for key in range(6):
        members = [(c, p) for k, c, p in rows if k == key]
        head = min(members, key=lambda m: (m[0] if turn == 0 else order[key, m[0]], m[0]))
        for c, p in members:
            if p != head[1]:
                want.setdefault(c, {}).setdefault(head[0], []).append(key)
    got = _star(df, turn)
    assert {(r.a, r.b) for r in got.collect()} == {(a, b) for a, heads in want.items() for b in heads}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
