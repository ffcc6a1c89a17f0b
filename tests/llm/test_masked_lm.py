import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnweave.llm.common import WordHasher
from tarnweave.llm.masked_lm import PIECE, AdaGrad, Vocabulary, WindowNetwork, count_words, huffman, learn_vocabulary, pseudo_likelihood, score, train


def small_vocabulary(own=5, shared=2):
    words = np.arange(own, dtype=np.uint64) * np.uint64(1000003)
    return Vocabulary(words, np.arange(own, 0, -1) * 10, np.array([3] * shared), np.array([2] * shared))


def test_huffman():
    counts = np.array([50, 20, 20, 5, 4, 0])
    begin, node, side, odds = huffman(counts)
    depth = np.diff(begin)
    assert depth.argmin() == 0 and len(odds) == 5 and abs(sum(0.5**depth) - 1) < 1e-12
    codes = {tuple(zip(node[a:b].tolist(), side[a:b].tolist())) for a, b in zip(begin[:-1], begin[1:])}
    assert len(codes) == 6
    # the least possible mean length, by trying all sorted lengths that fill a code
    mass = counts + 0.5
    best = min(sum(m * d for m, d in zip(sorted(mass, reverse=True), ds)) for ds in itertools.combinations_with_replacement(range(1, 6), 6) if sum(0.5**d for d in ds) == 1)
    assert (mass * depth).sum() == pytest.approx(best)
    # the odds give back the unigram
    p = [np.prod([1 / (1 + np.exp(-s * odds[n])) for n, s in zip(node[a:b], side[a:b])]) for a, b in zip(begin[:-1], begin[1:])]
    assert np.allclose(p, mass / mass.sum())


@pytest.mark.parametrize("top", [1, 3, 64])
def test_gradient_and_log_probabilities(monkeypatch, top):
    monkeypatch.setattr("tarnweave.llm.masked_lm.TOP", top)
    rng = np.random.default_rng(0)
    v = small_vocabulary()
    net = WindowNetwork(v, width=4)
    net.rows[net.base :] += rng.standard_normal(net.rows[net.base :].shape)
    leaves, begins = rng.integers(0, 7, 20), np.array([0, 7, 7, 20])
    context = net.context(leaves, begins)
    places = np.arange(4) * (v.edge + 1)
    seen = v.as_input(leaves)
    assert (context[:, 0] - places).tolist() == [v.edge, v.edge, *seen[1:3]] and (context[:, 6] - places).tolist() == [*seen[4:6], v.edge, v.edge]
    total = lambda: float(net.log_probabilities(context, leaves).astype(float).sum())
    rows, times, grads = net.gradient(context, leaves)
    assert len(set(rows.tolist())) == len(rows) and times[rows < net.base].sum() == 80
    for r, g in zip(rows, grads):
        at = np.abs(g).argmax()
        if abs(g[at]) < 0.05:
            continue
        net.rows[r, at] += 1e-2
        up = total()
        net.rows[r, at] -= 2e-2
        down = total()
        net.rows[r, at] += 1e-2
        assert (up - down) / 2e-2 == pytest.approx(g[at], rel=0.05, abs=5e-3)
    # probabilities of all leaves sum to one in every context
    assert np.allclose(sum(np.exp(net.log_probabilities(context, np.full(20, c))) for c in range(7)), 1, atol=1e-5)


def test_untrained_is_the_unigram():
    v = small_vocabulary()
    net = WindowNetwork(v)
    leaves = np.arange(7)
    assert np.allclose(net.log_probabilities(net.context(leaves, np.array([0, 7])), leaves) + v.log_inside, v.unigram(), atol=1e-5)


def test_learns_from_both_sides():
    v = small_vocabulary()
    leaves = np.tile(np.array([0, 1, 2, 1]), 500)
    net = WindowNetwork(v)
    context, ada = net.context(leaves, np.array([0, len(leaves)])), AdaGrad(net, 0.2)
    for _ in range(60):
        ada.step(*net.gradient(context, leaves))
    assert net.log_probabilities(context, leaves).mean() > -0.1


def test_vocabulary(spark):
    """Counts, ties and shared leaves against a plain count; probabilities of all known words sum to one."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 200) % 3000) for _ in range(50)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    hashes, n = np.unique(WordHasher().texts([t.encode() for t in texts])[0], return_counts=True)
    counts = count_words(docs)
    assert {r.word: r.n for r in counts.collect()} == dict(zip(hashes.view(np.int64).tolist(), n.tolist()))
    v, total = learn_vocabulary(counts, per_root=4)
    assert total == 10_000 and v.own == int(4 * 10_000 ** (1 / 3)) and v.rare == v.own // 8
    leaves = v.leaves(hashes)
    assert (np.bincount(leaves, n, len(v.counts)) == v.counts).all()
    assert n[leaves < v.own].min() >= n[leaves >= v.own].max()
    assert np.exp(v.unigram()[leaves]).sum() == pytest.approx(1, abs=1e-6)
    bigger, _ = learn_vocabulary(counts, per_root=8)
    assert bigger.own > v.own


def test_scores_by_hand(spark):
    """The query's rows against one word after another, from the trained weights."""
    texts = ["the cat sat on the mat", "", "the dog", "dog", "on the mat the cat sat \n again"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    v, total = learn_vocabulary(count_words(docs))
    net = train(docs, v, total)
    got = {r.id: r for r in score(docs, net).collect()}
    for i, t in enumerate(texts):
        leaves = v.leaves(WordHasher().texts([t.encode()])[0])
        pll = 0.0
        for k, leaf in enumerate(leaves):
            h = np.zeros(net.width)
            for place, step in enumerate((-2, -1, 1, 2)):
                near = v.as_input(leaves[k + step : k + step + 1])[0] if 0 <= k + step < len(leaves) else v.edge
                h += net.rows[place * (v.edge + 1) + near, : net.width]
            h = np.tanh(h)
            for at in range(v.begin[leaf], v.begin[leaf + 1]):
                row = net.rows[net.base + v.node[at]].astype(float)
                pll -= np.log1p(np.exp(-v.side[at] * (h @ row[:-1] + row[-1])))
            pll += v.log_inside[leaf]
        assert got[i].n_tokens == len(leaves) and got[i].pll == pytest.approx(pll, abs=1e-3)


def test_scores(spark, nasty, nothing):
    rows = [(i, "the cat sat on the mat and the dog ran to the door " * 20) for i in range(40)] + [(99, "mat the the on and door door cat ran dog to sat the " * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.id: r for r in pseudo_likelihood(docs, rounds=3).collect()}
    assert got[0].pll == got[1].pll and got[0].mean_pll > got[99].mean_pll + 0.5
    assert got[0].n_tokens == 260 and got[0].mean_pll == pytest.approx(got[0].pll / 260)
    odd = pseudo_likelihood(nasty).collect()
    assert len(odd) == nasty.count()
    assert {(r.n_tokens, r.pll, r.mean_pll) for r in odd if r.id in (1, 2, 3, 9)} == {(0, 0.0, None)}
    assert pseudo_likelihood(nothing).count() == 0


def test_same_scores_however_split(spark):
    """Several shards and several pieces of weights, and the same scores from any split of the input."""
    rng = np.random.default_rng(2)
    docs = spark.createDataFrame([(i, " ".join(f"w{int(x)}" for x in rng.zipf(1.2, 150) % 5000)) for i in range(300)], "doc_id long, text string")
    v, total = learn_vocabulary(count_words(docs))
    net = WindowNetwork(v)
    assert len(net.rows) > PIECE and total > 4 * 2 * len(v.counts)
    once, again = ({r.id: r.pll for r in pseudo_likelihood(docs.repartition(k), leaf_words=2).orderBy(F.col("id")).collect()} for k in (2, 8))
    assert once == again
