import random

import numpy as np
import pytest

from tarnweave.llm.decontaminate import Matcher, align, contaminated, drop_contaminated, plain


def slow(a, b, miss=0.5, gap=0.5):
    t = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            t[i][j] = max(0, t[i - 1][j - 1] + (1 if a[i - 1] == b[j - 1] else -miss), t[i - 1][j] - gap, t[i][j - 1] - gap)
    return max(map(max, t))


def test_alignment_against_slow():
    rng = np.random.default_rng(1)
    for _ in range(40):
        a, b = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 15))
        score, x, y = align(a, b)
        assert score == pytest.approx(slow(a.tolist(), b.tolist()))
        assert slow(a.tolist(), b[x:y].tolist()) == pytest.approx(score)


def words(rng, n):
    return ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]


def test_finds_edited_copies(spark):
    rng = random.Random(8)
    items = [words(rng, 40) for _ in range(5)]
    rows, want = [], set()
    for d in range(60):
        text = words(rng, 200)
        if d % 3 == 0:
            copy = list(items[d % 5])
            for k in rng.sample(range(40), [0, 4, 10][d // 3 % 3]):
                copy[k : k + 1] = rng.choice([[], ["new"], ["two", "more"]])
            text[100:100] = copy
            want.add((d, d % 5))
        rows.append((d, " ".join(text).upper() if d % 2 else ", ".join(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)] + [(7, None), (8, "..."), (9, "")], "item_id long, text string")
    for block in (200_000, 50):
        got = contaminated(docs, bench, block_words=block).collect()
        assert {(r.id, r.item_id) for r in got} == want
        assert all(95 <= r.begin <= 105 and 130 <= r.end <= 160 for r in got)
    assert {r.doc_id for r in drop_contaminated(docs, bench, block_words=50).collect()} == {d for d, _ in rows} - {d for d, _ in want}


def test_a_passage_in_very_many_documents_is_found(spark):
    rng = random.Random(9)
    item = words(rng, 30)
    docs = spark.createDataFrame([(d, " ".join(words(rng, 20) + item)) for d in range(300)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    assert contaminated(docs, bench).count() == 300


def test_an_edited_copy_as_the_only_trace_is_found(spark):
    rng = random.Random(10)
    item = words(rng, 40)
    copy = [f"new{k}" if k % 4 == 3 else w for k, w in enumerate(item)]  # 10 of 38 n-grams survive
    docs = spark.createDataFrame([(d, " ".join(words(rng, 60) + copy * (d == 3) + words(rng, 60))) for d in range(6)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    (got,) = contaminated(docs, bench).collect()
    assert got.id == 3 and got.score == pytest.approx(slow(item, copy) / 40)
    assert {r.doc_id for r in drop_contaminated(docs, bench).collect()} == {0, 1, 2, 4, 5}


def test_words_are_folded():
    assert plain("ÉCOLE".encode()) == plain("École".encode()) == plain("e\u0301cole".encode()) == "école".encode()
    assert plain("“Hello”—it’s «fine», ¿no?…".encode()).split() == b"hello it s fine no".split()


def test_alignment_of_very_long_texts_takes_little_memory():
    import tracemalloc

    rng = np.random.default_rng(2)
    text = rng.integers(0, 1 << 60, 1_000_000)
    item = rng.integers(0, 1 << 60, 1000)
    text[500_000:500_040] = item[:40]
    tracemalloc.start()
    score, begin, end = align(item[:100], text)
    assert (score, begin, end) == (40, 500_000, 500_040) and tracemalloc.get_traced_memory()[1] < 150 << 20  # rows of any number of item words take as much
    tracemalloc.stop()


def test_against_all_pairs(spark):
    """50 texts and 20 items, edited at all rates: every pair that scores is found (the seeds lose at most one in a hundred)."""
    rng = random.Random(12)
    common = words(rng, 12)
    filler = lambda n: [rng.choice(common) if rng.random() < 0.5 else w for w in words(rng, n)]
    items = [filler(rng.randint(20, 60)) for _ in range(20)]
    texts = []
    for d in range(50):
        text = filler(80)
        for i in rng.sample(range(20), 2):
            rate = rng.choice([0, 0, 0.1, 0.2, 0.25])
            copy = [w if rng.random() >= rate else rng.choice(["", "new", "two more"]) for w in items[i]]
            text[40:40] = [w for w in " ".join(copy).split()]
        texts.append(text)
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(f"i{i}", " ".join(x)) for i, x in enumerate(items)], "item_id string, text string")
    want = {(d, f"i{i}") for d, t in enumerate(texts) for i, x in enumerate(items) if slow(x, t) / len(x) >= 0.4}
    got = {(r.id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got <= want and len(want - got) <= len(want) // 100 and len(want) > 80


def test_edited_copies_beside_whole_ones(spark):
    """N-grams that only the whole copies have are rarer than those that survive in all; both are seeds."""
    rng = random.Random(13)
    item = words(rng, 40)
    copy = [f"new{k}" if k % 4 == 3 else w for k, w in enumerate(item)]
    docs = spark.createDataFrame([(d, " ".join(words(rng, 60) + (copy if d == 3 else item) + words(rng, 60))) for d in range(6)], "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id int, text string")
    assert {r.id for r in contaminated(docs, bench).collect()} == set(range(6))


def test_edges(spark, nasty, nothing):
    bench = spark.createDataFrame([(1, "same text here again"), (2, None), (3, "w5x5")], "item_id long, text string")
    got = contaminated(nasty, bench).collect()
    assert sorted((r.id or 0, r.item_id) for r in got) == [(0, 1), (4, 3), (5, 1), (6, 1), (6, 1)]
    kept = drop_contaminated(nasty, bench)
    assert kept.columns == nasty.columns and kept.count() == nasty.count() - 5
    assert contaminated(nothing, bench).count() == 0 and contaminated(nasty, bench.limit(0)).count() == 0
    assert drop_contaminated(nasty, bench.limit(0)).count() == nasty.count()


def test_two_passes_whatever_the_number_of_items(spark):
    """400 items, a few hundred times the words of the smallest block: the rows of one block and of many agree, and one block reads the texts twice."""
    rng = random.Random(14)
    items = [words(rng, rng.choice([1, 2, 3, 12, 30])) for _ in range(400)]
    docs = spark.createDataFrame([(d, " ".join(words(rng, 50) + items[d * 7 % 400] + words(rng, 50) + items[d])) for d in range(80)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    read = spark.sparkContext.accumulator(0)

    def watched(batches, read=read):
        for b in batches:
            read.add(b.num_rows)
            yield b

    got = sorted(map(tuple, contaminated(docs.mapInArrow(watched, docs.schema), bench).collect()))
    assert read.value == 2 * 80
    assert {(d, i) for d in range(80) for i in (d, d * 7 % 400)} <= {(r[0], r[1]) for r in got}
    frequency = np.full(5000, 3)
    one, many = Matcher([(i, " ".join(x)) for i, x in enumerate(items)]), [Matcher([(i, " ".join(x))]) for i, x in enumerate(items)]
    for m in (one, *many):
        m.seed(frequency, 0.25, 8, 8)
    assert sorted(map(tuple, contaminated(docs, bench, block_words=1500).collect())) == got
    assert len(one.grams[3].item) == sum(len(m.grams[3].item) for m in many if 3 in m.grams)
