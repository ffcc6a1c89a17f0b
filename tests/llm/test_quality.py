import itertools
import random
import zlib

import numpy as np
import pytest

from tarnweave.llm import quality as Q


def test_marginals_against_enumeration():
    rng = np.random.default_rng(2)
    field = Q.LineField(3)
    field.steps = rng.normal(size=(2, 2))
    lengths = np.array([3, 1, 5])
    unary = rng.normal(size=(9, 2))
    p, pairs, log_z = field.marginals(unary, lengths, np.ones(9))
    at, steps = 0, np.zeros((2, 2))
    for c, n in enumerate(lengths):
        u = unary[at : at + n]
        paths = list(itertools.product((0, 1), repeat=int(n)))
        w = np.exp([sum(u[i, y] for i, y in enumerate(path)) + sum(field.steps[a, b] for a, b in zip(path, path[1:])) for path in paths])
        assert log_z[c] == pytest.approx(np.log(w.sum()))
        for i in range(n):
            assert p[at + i, 1] == pytest.approx(sum(x for x, path in zip(w, paths) if path[i]) / w.sum())
        for path, x in zip(paths, w / w.sum()):
            for a, b in zip(path, path[1:]):
                steps[a, b] += x
        at += n
    assert np.allclose(pairs, steps)


def test_long_chains_in_parts_as_line_by_line(monkeypatch):
    rng = np.random.default_rng(4)
    field = Q.LineField(3)
    field.steps = rng.normal(size=(2, 2)) * 3
    lengths = np.array([1, 2, 3, 7, 16, 17, 1025, 4, 3000])
    unary = rng.normal(size=(lengths.sum(), 2)) * 4
    weights = rng.random(lengths.sum())
    results = []
    for limit in (1, 5, 1024, 1 << 30):
        monkeypatch.setattr(Q, "LONG", limit)
        results.append(field.marginals(unary, lengths, weights))
    for p, pairs, log_z in results[:-1]:
        assert np.allclose(p, results[-1][0], atol=1e-9) and np.allclose(pairs, results[-1][1]) and np.allclose(log_z, results[-1][2])
    assert np.allclose(results[0][0].sum(1), 1)


def test_a_very_long_text_takes_few_steps(monkeypatch):
    """300,000 lines: some 2,200 numpy steps each way, not 600,000."""
    steps, plain = [], np.logaddexp
    monkeypatch.setattr(np, "logaddexp", lambda *a: (steps.append(1), plain(*a))[1])
    field = Q.LineField(3)
    p, _, _ = field.marginals(np.random.default_rng(5).normal(size=(300_000, 2)), np.array([300_000]))
    assert len(steps) < 4000 and np.allclose(p.sum(1), 1)


def corpus(n):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    for d in range(n):
        lines = [" ".join(word() for _ in range(rng.randint(3, 12))) + "." for _ in range(rng.randint(1, 8))]
        if d % 4 == 0:
            lines = [x.upper().replace(" ", "!! ") + "$$$" for x in lines]
        yield d, "\n".join(lines), int(d % 4 != 0)


def test_held_out_accuracy(spark):
    rows = list(corpus(400))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q, 0) for d, _, q in rows], "doc_id long, quality int, toxic int")
    scored = Q.score(docs, Q.fit(docs, labels))
    got = {r.doc_id: r.score for r in scored.collect()}
    held = [d for d, _, _ in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert {r[0] for r in docs.where(Q.held_out("doc_id")).select("doc_id").collect()} == set(held) and held
    truth = {d: q for d, _, q in rows}
    assert all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[d] >= 0.3) == truth[d] for d in held]) > 0.97
    # the bound holds, and held-out labels aren't read
    assert Q.fit(docs, labels.where("doc_id IN (" + ",".join(map(str, held)) + ")")) is None
    assert Q.fit(docs, labels, max_docs=10) is not None


def test_neighbours_matter():
    a, _ = Q.document_features(b"one line\nTWO!! LINES$$$")
    b, _ = Q.document_features(b"one line\ntwo lines")
    assert not np.allclose(a[0], b[0])


def test_scores_against_enumeration(spark):
    """Scores of a table are the length-weighted marginals that enumerating all label paths gives."""
    rows = [(d, "\n".join(t.split("\n")[:6])) for d, t, _ in corpus(60)] + [(60, ""), (61, None), (62, "a\n\nb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    field = Q.fit(docs, spark.createDataFrame([(d, q) for d, _, q in corpus(60)], "doc_id long, quality int"))
    got = {r.doc_id: r.score for r in Q.score(docs, field).collect()}
    for d, text in rows:
        x, length = Q.document_features((text or "").encode())
        u = field._unary(x)
        paths = list(itertools.product((0, 1), repeat=len(x)))
        w = np.exp([sum(u[i, y] for i, y in enumerate(p)) + sum(field.steps[a, b] for a, b in zip(p, p[1:])) for p in paths])
        good = [sum(v for v, p in zip(w, paths) if p[i]) / w.sum() for i in range(len(x))]
        assert got[d] == pytest.approx(np.average(good, weights=length), abs=1e-6)


def test_the_sample_is_bounded_and_the_same_each_time(spark):
    rows = list(corpus(200))
    docs = spark.createDataFrame([r[:2] for r in rows] + [(d, t + " other") for d, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(d, q) for d, _, q in rows], "doc_id long, quality int")
    a, b = (Q.fit(x, labels, max_docs=40).states for x in (docs.repartition(3), docs.repartition(7)))
    assert np.array_equal(a, b)
    assert Q.fit(docs, labels, max_bytes=1) is None


def test_edges(spark, nasty, nothing):
    labels = spark.createDataFrame([(4, 1, 0), (7, 0, 1), (8, 1, None), (None, 1, 0), (77, 0, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    field = Q.fit(nasty, labels)
    for f in (None, field):
        got = Q.score(nasty, f, keep=tuple(nasty.columns), name="mine").collect()
        assert len(got) == nasty.count() and all(0 <= r.mine <= 1 for r in got)
    assert {r.score for r in Q.score(nasty, None).collect()} == {0.5}
    assert Q.score(nothing, None).count() == 0 and Q.fit(nothing, labels) is None and Q.fit(nasty, labels.limit(0)) is None
