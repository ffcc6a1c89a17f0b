"""LM scoring: masked pseudo-likelihood with a bidirectional window network in numpy.

Words are counted exactly. The most frequent ones, as many as ``PER_ROOT`` times the cube root
of the corpus's words, are leaves of a Huffman tree; all others share an eighth as many
leaves by hash, each with the same chance inside its leaf. The network sums embeddings of the
words at ``reach`` places on both sides of a masked word (a mark of its own beyond the text)
and gives from them the chance of either side at every node on the way to the word's leaf:
hierarchical softmax, so a word costs its code length rather than the vocabulary. Nodes start
at the odds of the counts, so the untrained network is the unigram model. A text's score is
the sum over its words of log p(word | both sides).

Training covers every word of every text: texts are dealt by hash into shards, sorted by it,
and each shard takes a pass of AdaGrad from the same start; a row of the weights becomes the
shards' mean by how often each used it, summed in order of the shards. So the scores do not
depend on how the input is split. Vocabulary, network and shards all grow with the corpus: a
shard has ``LEAF_WORDS`` words a leaf, so that weights stay a fixed share of the texts.
A worker holds the network once: some 90 bytes a leaf for weights, as much again in training,
and the tree's paths.

Defined results: null and empty texts have no words, score 0 and a null mean; very long texts
are scored whole; repeated rows agree; ties in frequency go by the word's hash; other columns
are ignored, whatever their names; an empty table gives an empty result; null identifiers need
no rule.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordHasher, encoded, signed, small_batches

#: Leaves for each cube root of the corpus's words; words a shard for each leaf; shared classes of rare context words.
PER_ROOT, LEAF_WORDS, RARE_INPUTS = 160, 50, 64
#: Nodes nearest to the root, most used of all, whose units are computed for every word by one matrix product.
TOP = 128
#: Rows of weights that travel together between shards and their mean.
PIECE = 4096


def huffman(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of at least two leaves: where each leaf's path begins (one more at the end), its nodes, its sides (+1, -1), and the log odds of +1 at each node."""
    n = len(counts)
    mass = np.concatenate((counts.astype(np.float64) + 0.5, np.zeros(n - 1)))
    parent, side = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int8)
    heap = [(m, i) for i, m in enumerate(mass[:n].tolist())]
    heapq.heapify(heap)
    for node in range(n, 2 * n - 1):
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        parent[a[1]] = parent[b[1]] = node
        side[a[1]], side[b[1]] = 1, -1
        mass[node] = a[0] + b[0]
        heapq.heappush(heap, (a[0] + b[0], node))
    leaf, at, steps = np.arange(n), np.arange(n), []
    while len(leaf):
        steps.append((leaf, parent[at], side[at]))
        at = parent[at]
        inner = at != 2 * n - 2
        leaf, at = leaf[inner], at[inner]
    leaf, node, way = (np.concatenate(x) for x in zip(*steps))
    order = np.argsort(leaf, kind="stable")
    plus = np.zeros(n - 1)
    up = np.flatnonzero(side == 1)
    plus[parent[up] - n] = mass[up]
    odds = np.log(plus) - np.log(mass[n:] - plus)
    return np.concatenate(([0], np.cumsum(np.bincount(leaf, minlength=n)))), (node[order] - n).astype(np.int32), way[order], odds.astype(np.float32)


def _on_grid(x: np.ndarray) -> np.ndarray:
    """Multiples of 2**-20 up to 512, as whole doubles: sums of 16 products of two such are exact, so a matrix product gives a row the same units wherever it stands, on any processor."""
    return np.rint(np.clip(x, -512, 512).astype(np.float64) * 2.0**20)


class Vocabulary:
    """Leaf of each word hash, its code, and log p(word | leaf)."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, rare_counts: np.ndarray, rare_words: np.ndarray):
        """``words`` by falling frequency; the shared leaves come after them."""
        order = np.argsort(words)
        self.words, self.leaf, self.own, self.rare = words[order], order.astype(np.int32), len(words), len(rare_counts)
        self.counts = np.concatenate((counts, rare_counts))
        self.begin, self.node, self.side, self.odds = huffman(self.counts)
        self.log_inside = np.concatenate((np.zeros(self.own), -np.log(np.maximum(rare_words, 1)))).astype(np.float32)
        self.inputs = min(self.own, max(256, self.own // 16))

    @property
    def edge(self) -> int:
        return self.inputs + RARE_INPUTS

    def leaves(self, hashes: np.ndarray) -> np.ndarray:
        out = self.own + (hashes % np.uint64(self.rare)).astype(np.int64)
        if self.own:
            at = np.minimum(np.searchsorted(self.words, hashes), self.own - 1)
            return np.where(self.words.take(at) == hashes, self.leaf.take(at), out)
        return out

    def as_input(self, leaves: np.ndarray) -> np.ndarray:
        """Context words: the frequent ones as they are, the rest in shared classes."""
        return np.where(leaves < self.inputs, leaves, self.inputs + leaves % RARE_INPUTS)

    def unigram(self) -> np.ndarray:
        """Log-probability of each leaf's words without context."""
        smooth = self.counts + 0.5
        return np.log(smooth / smooth.sum()) + self.log_inside


class WindowNetwork:
    """tanh of summed context embeddings, then a logistic unit at each node of the code.

    One matrix holds all weights: a row for each input at each place, then a row a node; the
    last column is the node's shift.
    """

    def __init__(self, vocabulary: Vocabulary, reach: int = 2, width: int = 15, seed: int = 13):
        self.v, self.reach, self.width = vocabulary, reach, width
        self.base = 2 * reach * (vocabulary.edge + 1)
        self.rows = np.zeros((self.base + len(vocabulary.odds), width + 1), np.float32)
        self.rows[: self.base, :width] = np.random.default_rng(seed).standard_normal((self.base, width)) * 0.3
        self.rows[self.base :, width] = vocabulary.odds

    def context(self, leaves: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Rows of the inputs at each place (2 * reach of them) around the words of texts that lie end to end."""
        n, r, inputs = len(leaves), self.reach, self.v.as_input(leaves)
        first, last = np.repeat(begins[:-1], np.diff(begins)), np.repeat(begins[1:], np.diff(begins))
        out = np.full((2 * r, n), self.v.edge, np.int64)
        at = np.arange(n)
        for k, step in enumerate([*range(-r, 0), *range(1, r + 1)]):
            to = at + step
            inside = (to >= first) & (to < last)
            out[k, inside] = inputs[to[inside]]
            out[k] += k * (self.v.edge + 1)
        return out

    def hidden(self, context: np.ndarray) -> np.ndarray:
        """With a last column of ones, for the shifts."""
        h = self.rows.take(context[0], 0)
        for c in context[1:]:
            h += self.rows.take(c, 0)
        np.tanh(h, out=h)
        h[:, self.width] = 1
        return h

    def _walk(self, leaves: np.ndarray):
        """For all words end to end: the word, row and side of each node on its path; where each word's begin.

        Numbers of nodes rise towards the root, so the top ones are the last.
        """
        start = self.v.begin.take(leaves)
        depth = self.v.begin.take(leaves + 1) - start
        first = np.cumsum(depth) - depth
        which = np.repeat(np.arange(len(leaves)), depth)
        at = np.arange(len(which)) + np.repeat(start - first, depth)
        return which, self.base + self.v.node.take(at), self.v.side.take(at), first

    def _split(self, h: np.ndarray, leaves: np.ndarray):
        """Signed units along all paths, and what they came from: the top nodes by a product, the others one by one."""
        which, node, side, first = self._walk(leaves)
        bound = max(self.base, len(self.rows) - TOP)
        high = node >= bound
        low = np.flatnonzero(~high)
        high = np.flatnonzero(high)
        z = np.empty(len(node), np.float32)
        cell = which.take(high) * (len(self.rows) - bound) + (node.take(high) - bound)
        z[high] = (_on_grid(h) @ _on_grid(self.rows[bound:]).T).ravel().take(cell) * 2.0**-40
        far, weights = h.take(which.take(low), 0), self.rows.take(node.take(low), 0)
        z[low] = np.einsum("ij,ij->i", far, weights)
        z *= side
        return z, side, first, bound, high, cell, low, which, node, far, weights

    def log_probabilities(self, context: np.ndarray, leaves: np.ndarray, step: int = 1024) -> np.ndarray:
        """Of the words' leaves."""
        out = np.empty(len(leaves), np.float32)
        for a in range(0, len(leaves), step):
            z, _, first, *_ = self._split(self.hidden(context[:, a : a + step]), leaves[a : a + step])
            out[a : a + step] = np.add.reduceat(np.minimum(z, 0) - np.log1p(np.exp(-np.abs(z))), first)
        return out

    def gradient(self, context: np.ndarray, leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the summed log-probability: rows that it touches, how often, and their gradients."""
        h = self.hidden(context)
        z, side, _, bound, high, cell, low, which, node, far, weights = self._split(h, leaves)
        g = (side / (1 + np.exp(z))).astype(np.float32)
        tops = np.zeros(len(h) * (len(self.rows) - bound), np.float32)
        tops[cell] = g.take(high)
        tops = tops.reshape(len(h), -1)
        under = tops @ self.rows[bound:]
        times = np.bincount(node.take(high) - bound, minlength=len(self.rows) - bound)
        used = np.flatnonzero(times)
        parts = [(bound + used, times[used], (tops.T @ h)[used])]
        if len(low):
            own, of = g.take(low)[:, None], which.take(low)
            weights *= own
            far *= own
            start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
            under[of.take(start)] += np.add.reduceat(weights, start, axis=0)
            parts.append(self._by_row(node.take(low), far, None))
        under *= 1 - h * h
        parts.append(self._by_row(context.ravel(), under, len(leaves)))
        return tuple(np.concatenate(x) for x in zip(*parts))

    @staticmethod
    def _by_row(rows: np.ndarray, values: np.ndarray, repeat: int | None):
        """Sums of the values of equal rows; the values repeat after so many rows."""
        order = np.argsort(rows)
        rows = rows.take(order)
        start = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
        of = order if repeat is None else order % repeat
        return rows.take(start), np.diff(np.append(start, len(rows))), np.add.reduceat(values.take(of, 0), start, axis=0)


class AdaGrad:
    """Steps on the rows that a batch touches."""

    def __init__(self, network: WindowNetwork, rate: float):
        self.network, self.rate = network, rate
        self.squares = np.full_like(network.rows, 1e-6)
        self.used = np.zeros(len(network.rows), np.float32)

    def step(self, rows: np.ndarray, times: np.ndarray, grads: np.ndarray) -> None:
        seen = self.squares.take(rows, 0) + grads * grads
        self.squares[rows] = seen
        self.used[rows] += times
        self.network.rows[rows] = self.network.rows.take(rows, 0) + self.rate * grads / np.sqrt(seen)


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, n): exact counts by 64-bit word hash."""

    def run(batches):
        hasher = WordHasher()
        for b in batches:
            words, n = np.unique(hasher.texts(encoded(b.column(0)))[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(signed(words)), pa.array(n.astype(np.int64))], names=["word", "n"])

    return docs.select(text_col).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn_vocabulary(counts: DataFrame, per_root: int = PER_ROOT) -> tuple[Vocabulary, int]:
    """The vocabulary and the corpus's number of words. The driver gets the leaves, which grow with the cube root of that number."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    own = max(16, int(per_root * total ** (1 / 3)))
    shared = max(2, own // 8)
    top = counts.orderBy(F.desc("n"), "word").limit(own).toPandas() if total else None
    words = np.zeros(0, np.uint64) if top is None else top["word"].to_numpy(np.int64).view(np.uint64)
    n = np.zeros(0, np.int64) if top is None else top["n"].to_numpy(np.int64)
    rare_counts, rare_words = np.zeros(shared, np.int64), np.zeros(shared, np.int64)
    if len(words) == own:
        # rows after the last leaf, in its order
        after = (F.col("n") < int(n[-1])) | ((F.col("n") == int(n[-1])) & (F.col("word") > int(words[-1:].view(np.int64)[0])))
        bucket = F.pmod(F.pmod("word", F.lit(shared)) + F.when(F.col("word") < 0, F.lit((1 << 64) % shared)).otherwise(F.lit(0)), F.lit(shared))
        for b, k, w in counts.where(after).groupBy(bucket.alias("b")).agg(F.sum("n"), F.count(F.lit(1))).collect():
            rare_counts[b], rare_words[b] = k, w
    return Vocabulary(words, n, rare_counts, rare_words), total


def train(docs: DataFrame, vocabulary: Vocabulary, total: int, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, batch: int = 1024, rate: float = 0.2, leaf_words: int = LEAF_WORDS) -> WindowNetwork:
    """A network averaged over the shards, each trained on all of its words."""
    network = WindowNetwork(vocabulary)
    shards = max(1, -(-total // (leaf_words * len(vocabulary.counts))))
    texts = docs.select(F.xxhash64(id_col, text_col).alias("key"), F.col(text_col).alias("body")).where(F.length("body") > 0)
    dealt = texts.repartition(shards, "key").sortWithinPartitions("key")
    schema = "piece long, shard long, weights binary, used binary"

    for _ in range(rounds):
        start = network.rows.copy()

        def learn(batches, start=start):
            from pyspark import TaskContext

            hasher, own = WordHasher(), WindowNetwork(vocabulary)
            own.rows[...] = start
            ada = AdaGrad(own, rate)
            for b in batches:
                words, begins = hasher.texts(encoded(b.column(1)))
                leaves = vocabulary.leaves(words)
                around = own.context(leaves, begins)
                for a in range(0, len(leaves), batch):
                    ada.step(*own.gradient(around[:, a : a + batch], leaves[a : a + batch]))
            shard, moved = TaskContext.get().partitionId(), (own.rows - start) * ada.used[:, None]
            for p in range(0, len(moved), PIECE):
                if ada.used[p : p + PIECE].any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([p]), pa.array([shard]), pa.array([moved[p : p + PIECE].tobytes()], pa.binary()), pa.array([ada.used[p : p + PIECE].tobytes()], pa.binary())], names=["piece", "shard", "weights", "used"]
                    )

        def merge(batches):
            at, moved, used = None, None, None

            def done():
                mean = (moved / np.maximum(used, 1)[:, None]).astype(np.float32)
                return pa.RecordBatch.from_arrays([pa.array([at]), pa.array([mean.tobytes()], pa.binary())], names=["piece", "mean"])

            for b in batches:
                for p, w, u in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    u = np.frombuffer(u, np.float32).astype(np.float64)
                    w = np.frombuffer(w, np.float32).astype(np.float64).reshape(len(u), -1)
                    if p != at:
                        if at is not None:
                            yield done()
                        at, moved, used = p, w, u
                    else:
                        moved, used = moved + w, used + u
            if at is not None:
                yield done()

        pieces = dealt.mapInArrow(learn, schema).repartition("piece").sortWithinPartitions("piece", "shard")
        for p, mean in pieces.mapInArrow(merge, "piece long, mean binary").collect():
            rows = network.rows[p : p + PIECE]
            rows += np.frombuffer(mean, np.float32).reshape(rows.shape)
    return network


def score(docs: DataFrame, network: WindowNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row an input row: id, n_tokens, pll (sum of log-probabilities), mean_pll."""

    def run(batches: Iterator[pa.RecordBatch]):
        hasher, v = WordHasher(), network.v
        for b in batches:
            words, begins = hasher.texts(encoded(b.column(1)))
            leaves = v.leaves(words)
            values = network.log_probabilities(network.context(leaves, begins), leaves).astype(np.float64) + v.log_inside[leaves]
            sums = np.array([values[x:y].sum() for x, y in zip(begins[:-1], begins[1:])], np.float64)
            n = np.diff(begins)
            mean = pa.array(sums / np.maximum(n, 1), pa.float64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(sums), mean], names=["id", "n_tokens", "pll", "mean_pll"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("body"))
    schema = rows.select("id").schema.add("n_tokens", "long").add("pll", "double").add("mean_pll", "double")
    return rows.mapInArrow(run, schema)


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, per_root: int = PER_ROOT, leaf_words: int = LEAF_WORDS) -> DataFrame:
    """Counts, trains and scores ``docs``."""
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "words")
    counts = scratch.cut(count_words(docs, text_col))
    vocabulary, total = learn_vocabulary(counts, per_root)
    scratch.drop(counts)
    return score(docs, train(docs, vocabulary, total, id_col, text_col, rounds, leaf_words=leaf_words), id_col, text_col)
