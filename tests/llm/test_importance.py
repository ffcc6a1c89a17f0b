import math
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tarnweave.llm.importance import RunHasher, bucket_counts, draw, radix_select, resample


def runs(text):
    w = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").encode().lower())
    return [zlib.crc32(b" ".join(w[i : i + k])) % 10_000 for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def some_texts(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcXYZ09é") for _ in range(rng.choice([1, 2, 3, 5, 300])))
    return [rng.choice(" -\n").join(word() for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_runs_against_zlib():
    texts, h = [t.encode() for t in [*some_texts(60), "", "A", "a b", " ".join(f"w{i}" for i in range(3000))]], RunHasher()
    h.SEGMENT, h.BLOCK = 997, 64  # texts in several segments, runs across blocks
    got = [[] for _ in texts]
    for at, _, crc, size, doc in h.groups(texts):
        for d, bucket in h.runs(crc, size, doc):
            for x, y in zip(d, bucket):
                got[at + x].append(int(y))
    assert [sorted(g) for g in got] == [sorted(runs(t.decode())[0]) for t in texts]


def test_radix_select(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.randint(-50, 50), rng.randint(-(1 << 63), (1 << 63) - 1), 7]) for _ in range(60)]
    df = spark.createDataFrame([(v,) for v in values], "v long").coalesce(2).cache()
    for k, descending, bits in ((31, False, 7), (31, True, 12), (1, True, 16), (60, False, 16)):
        v = sorted(values, reverse=descending)[k - 1]
        assert radix_select(df, "v", k, descending, bits) == (v, sorted(values, reverse=descending).index(v))
    assert radix_select(df, "v", 61) is None and radix_select(df, "v", 0) is None
    assert radix_select(df.where("v = 7"), "v", 1) == (7, 0)


def brute(rows, target, share=(5, 100)):
    t = Counter(b for text in target for b in runs(text)[0])
    s = Counter(b for _, text in rows for b in runs(text)[0])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10_000) / ((s[b] + 1) * (big_t + 10_000))))
    import hashlib

    out = []
    for i, text in rows:
        features, n = runs(text)
        u = (int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16) + 0.5) / 4294967296
        weight = sum(map(gain, features))
        out.append([i, n, len(features), weight, weight + math.floor(-1000 * math.log(-math.log(u))), None])
    fit = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for rank, r in enumerate(fit[: len(fit) * share[0] // share[1]], 1):
        r[5] = rank
    return out


def test_against_brute_force(spark):
    rows, target = list(enumerate(some_texts(300, 3))), some_texts(20, 4)
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string")
    got = resample(docs, wanted, share=(20, 100))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute(rows, target, (20, 100))), key=lambda r: r[0])


def test_ties_go_to_smaller_ids(spark):
    rows = [(i, 30, 5 if i % 2 else 6) for i in range(100)] + [(None, 30, 6), (200, 19, 99)]
    scored = spark.createDataFrame(rows, "id long, n_words long, score long").repartition(4)
    got = {r.id: r.rank for r in draw(scored, (60, 100)).collect()}
    want = [i for i in range(0, 100, 2)] + [None] + [1, 3, 5, 7, 9, 11, 13, 15, 17]
    assert {i: r for i, r in got.items() if r} == {i: k for k, i in enumerate(want, 1)}
    # all in one tie, half of it the same row
    same = spark.createDataFrame([(4, 30, 5)] * 50 + [(i, 30, 5) for i in range(50)], "id long, n_words long, score long")
    assert sorted(r.rank for r in draw(same, (30, 100)).where("rank IS NOT NULL").collect()) == list(range(1, 31))


def test_edges(spark, nasty, nothing):
    got = resample(nasty, nothing, share=(50, 100))
    assert got.columns == ["id", "n_words", "n_features", "weight", "score", "rank"]
    found = got.collect()
    assert len(found) == nasty.count() and all(r.weight == r.n_features == 0 and r.rank is None for r in found if r.id in (1, 2, 3, 9))
    want = brute([(r.doc_id, r.text) for r in nasty.collect()], [], (50, 100))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[4], r[5] or 0)
    assert sorted(map(tuple, found), key=key) == sorted(map(tuple, want), key=key)
    assert resample(nothing, nasty).count() == 0 and bucket_counts(nothing).count() == 0
    assert resample(nasty.select("doc_id", F.col("text").alias("t")), nasty, text_col="t").count() == nasty.count()
