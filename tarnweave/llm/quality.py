"""Quality classifier: a linear-chain conditional random field over lines.

Every line of a text is good or bad; its features come from the line, from its
neighbours and from how often it repeats in the text. Lines of labelled documents take
their document's label for training. The score of a text is the mean of its lines'
forward-backward marginals of "good", weighted by line length.

The field is fitted on the driver to at most ``max_docs`` labelled documents of at most
``max_bytes`` bytes each, those with the least hash of their identifier (the documented bounds
of the labelled sample, and so of the data that the driver gets); scoring covers every line
of every text.

Defined results: a text without lines (null, empty) is one empty line and gets that
line's score; rows are scored one by one, so repeated rows agree and ties need no rule; very
long texts are scored whole; without any labelled row every score is 0.5; labels of rows that
aren't in the table are not used; a label of null is no label; of several texts under one
identifier the one of least hash is learned from; an empty table gives an empty result; other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import encoded, small_batches

MAX_DOCS, MAX_BYTES = 3000, 20_000

_CLASS = np.zeros(256, np.uint8)  # 0 other bytes of letters, 1 lower, 2 upper, 3 digit, 4 space, 5 sentence marks, 6 other marks
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
for _c in b" \t\r\x0b\x0c\n":
    _CLASS[_c] = 4
for _c in b".,;:'\"?-()":
    _CLASS[_c] = 5
for _c in b"!#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = 6
_BANG, _PIPE = ord("!"), ord("|")
N_FEATURES = 15


def _one(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features and weights of all lines of a text."""
    lines = text.split(b"\n")
    raw = np.frombuffer(text + b"\n", np.uint8)
    kind = _CLASS[raw]
    ends = np.cumsum([len(x) + 1 for x in lines])
    begins = np.concatenate(([0], ends[:-1]))
    add = lambda mask: np.add.reduceat(mask.astype(np.float32), begins)
    n = np.maximum((ends - begins - 1).astype(np.float32), 1)
    space = kind == 4
    starts = ~space & np.concatenate(([True], space[:-1]))
    n_words = np.maximum(add(starts), 1)
    lone = (kind == 6) & np.concatenate((space[1:], [True])) & np.concatenate(([True], space[:-1]))  # marks that stand alone
    tails = (kind == 6) & np.concatenate((space[1:], [True]))  # words that end in odd marks
    stops = (kind == 5) & np.concatenate((space[1:], [True]))
    seen: dict[bytes, int] = {}
    distinct, longest = np.empty(len(lines), np.float32), np.empty(len(lines), np.float32)
    for i, x in enumerate(lines):
        found = x.split()
        distinct[i] = len(set(found)) / max(1, len(found))
        longest[i] = max(map(len, found), default=0)
        seen[x] = seen.get(x, 0) + 1
    copies = np.array([seen[x] for x in lines], np.float32)
    x = np.stack(
        [
            np.ones_like(n), np.log1p(n), np.log1p(n_words), add(kind == 2) / n, add(kind == 3) / n, add(kind == 6) / n, add(raw == _BANG) / n_words, add(raw == _PIPE) / n_words,
            add(tails) / n_words, add(lone) / n_words, add(stops) / n_words, n / n_words / 10, np.minimum(longest, 60) / 20, distinct, np.log(copies),
        ],
        axis=1,
    ).astype(np.float32)
    return x, n


def document_features(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Features of each line with those of the line before and behind, and of the whole text; line lengths."""
    x, n = _one(text)
    body = x[:, 1:]
    nothing = np.zeros((1, body.shape[1]), np.float32)
    share = n / n.sum()
    whole = np.repeat((share @ body)[None], len(x), 0)
    words = text.split()
    rate = np.float32(len(set(words)) / np.sqrt(max(1, len(words))) / 10)
    few = np.float32(len(set(words)) / max(1, len(words)))
    extra = np.tile(np.array([rate, few, np.log1p(len(words)) / 5, np.log1p(len(x)) / 3], np.float32), (len(x), 1))
    return np.concatenate([x, np.concatenate([nothing, body[:-1]]), np.concatenate([body[1:], nothing]), whole, extra], axis=1), n


#: Lines from which on a chain is summed in parts.
LONG = 1024


def chain_sums(unary: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Forward sums of one chain by a scan in two levels: about 2 sqrt(n) numpy steps for n lines.

    The chain is cut into sqrt(n) parts of equal length. All parts take their lines in step, each
    carrying the 2 x 2 matrix of sums from its entry to the line; then the parts' last matrices are
    chained, and each line gets its part's entry through its matrix.
    """
    n = len(unary)
    size = math.isqrt(n - 1) + 1
    parts = -(-n // size)
    u = np.zeros((parts * size, 2))
    u[:n] = unary  # what is added behind the end touches no line before it
    u = u.reshape(parts, size, 1, 2)
    inner = np.empty((parts, size, 2, 2))
    inner[:, 0] = steps + u[:, 0]
    inner[0, 0] = np.where(np.eye(2) > 0, u[0, 0], -np.inf)
    for t in range(1, size):
        before = inner[:, t - 1]
        inner[:, t] = u[:, t] + np.logaddexp(before[:, :, :1] + steps[0], before[:, :, 1:] + steps[1])
    entry = np.zeros((parts, 2))
    for k in range(1, parts):
        entry[k] = np.logaddexp(entry[k - 1, 0] + inner[k - 1, -1, 0], entry[k - 1, 1] + inner[k - 1, -1, 1])
    return np.logaddexp(entry[:, None, :1] + inner[:, :, 0], entry[:, None, 1:] + inner[:, :, 1]).reshape(-1, 2)[:n]


class LineField:
    """A two-label linear chain: states (features by label) and steps (from label to label)."""

    def __init__(self, width: int):
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.states, self.steps = np.zeros((width, 2)), np.zeros((2, 2))

    def _unary(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.states

    def marginals(self, unary: np.ndarray, lengths: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward-backward over chains that lie end to end: line marginals (rows x 2), expected steps (2 x 2, each by its line's weight), log partitions.

        Chains of more than LONG lines go one by one through ``chain_sums``. The others step together,
        longest first, so at each place the ones still open are the leading ones.
        """
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        forward = np.empty((len(unary), 2))
        backward = np.zeros((len(unary), 2))
        for c in np.flatnonzero(lengths > LONG):
            own = slice(starts[c], starts[c] + lengths[c])
            forward[own] = chain_sums(unary[own], self.steps)
            backward[own] = chain_sums(unary[own][::-1], self.steps.T)[::-1] - unary[own]
        order = np.argsort(-lengths, kind="stable")
        order = order[lengths[order] <= LONG]
        begin, size = starts[order], lengths[order]
        top = int(size[0]) if len(size) else 0
        forward[begin] = unary[begin]
        open_ = np.searchsorted(-size, -np.arange(top), side="left")  # chains longer than t
        for t in range(1, top):
            at = begin[: open_[t]] + t
            before = forward[at - 1]
            forward[at] = unary[at] + np.logaddexp(before[:, :1] + self.steps[0], before[:, 1:] + self.steps[1])
        for t in range(top - 1, 0, -1):
            at = begin[: open_[t]] + t
            behind = unary[at] + backward[at]
            backward[at - 1] = np.logaddexp(behind[:, :1] + self.steps[:, 0], behind[:, 1:] + self.steps[:, 1])
        last = starts + lengths - 1
        log_z = np.logaddexp(forward[last, 0], forward[last, 1])
        z = np.repeat(log_z, lengths)[:, None]
        p = np.exp(forward + backward - z)
        pairs = np.zeros((2, 2))
        inner = np.ones(len(unary), bool)
        inner[starts] = False
        at = np.flatnonzero(inner)
        if len(at) and weights is not None:
            for i in range(2):
                for j in range(2):
                    pairs[i, j] = np.exp(forward[at - 1, i] + self.steps[i, j] + unary[at, j] + backward[at, j] - z[at, 0]) @ weights[at]
        return p, pairs, log_z

    def fit(self, xs: list[np.ndarray], labels: np.ndarray, rounds: int = 150, rate: float = 0.05, ridge: float = 1e-3) -> "LineField":
        """Adam on the mean conditional log-likelihood of the label chains; a chain weighs one over its length."""
        x = np.concatenate(xs)
        lengths = np.array([len(a) for a in xs])
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
        self.mean[0] = 0
        self.scale[0] = 1
        z = (x - self.mean) / self.scale
        y = np.repeat(labels, lengths)
        weight = 1 / lengths
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        params = [self.states, self.steps]
        moment, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        total = len(xs)
        # a chain weighs one over its length: its gradient is the mean over its lines
        line_weight = np.repeat(weight, lengths) / total
        target = np.zeros((len(x), 2))
        target[np.arange(len(x)), y] = 1
        step_lines = np.ones(len(x), bool)
        step_lines[first] = False
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[step_lines], y[step_lines]), line_weight[step_lines])
        for k in range(1, rounds + 1):
            p, pairs, _ = self.marginals(z @ self.states, lengths, line_weight)
            grad = [z.T @ ((target - p) * line_weight[:, None]) - ridge * self.states, seen - pairs - ridge * self.steps]
            for i, g in enumerate(grad):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                params[i] += rate * (moment[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.999**k)) + 1e-8)
        return self

    def scores(self, xs: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """Length-weighted mean marginal of label 1, one a document."""
        lengths = np.array([len(a) for a in xs])
        p, _, _ = self.marginals(self._unary(np.concatenate(xs)), lengths)
        w = np.concatenate(weights).astype(np.float64)
        first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        return np.add.reduceat(p[:, 1] * w, first) / np.add.reduceat(w, first)


def held_out(id_col: str) -> "F.Column":
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_docs: int = MAX_DOCS, max_bytes: int = MAX_BYTES) -> LineField | None:
    """A field fitted to labelled rows that are not held out; None without labels of both kinds."""
    known = labels.where(F.col(label_col).isNotNull() & ~held_out(id_col)).groupBy(F.col(id_col).alias("label_id")).agg(F.max(F.col(label_col)).cast("int").alias("label"))
    body = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), body.alias("body"), F.xxhash64(body).alias("hash")).where(F.octet_length("body") <= max_bytes)
    there = texts.select("id", "hash").join(known, F.col("id") == F.col("label_id")).groupBy("id").agg(F.min("hash").alias("hash"), F.first("label").alias("label"))
    # half of the bound for each label, so that the rarer one has its share
    sample = [there.where(F.col("label") == value).orderBy(F.xxhash64("id"), "id").limit(max_docs // 2) for value in (0, 1)]
    keys = sample[0].unionByName(sample[1]).collect()  # at most max_docs rows
    keys = docs.sparkSession.createDataFrame(keys, there.schema)
    picked = texts.join(F.broadcast(keys), ["id", "hash"]).dropDuplicates(["id", "hash"])
    rows = picked.select("id", "body", "label").orderBy(F.xxhash64("id"), "id").collect()
    if len({r[2] for r in rows}) < 2:
        return None
    labels_ = np.array([r[2] for r in rows])
    xs = [document_features((r[1] or "").encode("utf-8", "surrogatepass"))[0] for r in rows]
    return LineField(xs[0].shape[1]).fit(xs, labels_)


def score(docs: DataFrame, field: LineField | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """``keep`` and the score of each row's text."""
    small_batches(docs.sparkSession)
    columns = [f.name for f in docs.select(*keep).schema]

    def run(batches: Iterator[pa.RecordBatch]):
        for b in batches:
            texts, out, at = encoded(b.column(len(columns))), [], 0
            while field is not None and at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) < 1 << 20):
                    size += len(texts[upto])
                    upto += 1
                xs, ws = zip(*(document_features(t) for t in texts[at:upto]))
                out.extend(field.scores(list(xs), list(ws)).clip(0, 1).tolist())
                at = upto
            if field is None:
                out = [0.5] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(columns)], pa.array(out, pa.float64())], names=[*columns, name])

    schema = docs.select(*keep).schema.add(name, "double")
    body = "_body"
    while body in columns:
        body += "_"
    return docs.select(*keep, F.col(text_col).alias(body)).mapInArrow(run, schema)
