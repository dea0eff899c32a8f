"""Operator 2: document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's score comes from its own features and its
neighbours'; neighbouring labels are tied by transition weights.
Forward-backward gives each line's marginal, the length-weighted mean of the
good marginals is the document's raw quality, and a logistic curve learnt on
the same sample turns it into a score.

Learning takes ``TRAIN_DOCS`` labelled ids of each label at most, from outside
the held-out fold, those with the least hashes, and their texts of at most
``TRAIN_LINES`` lines. That is the bound on what the driver gathers.
A bad document holds good lines too: after a first fit to its document's
label, each line of a bad document is relabelled by its marginal, and the
field is fitted again.

Defined results: a null or empty text is one empty line; without rows of both
labels every score is 0.5; rows are scored one by one, repeated ids and copies
included; a null id counts as held out; a document labelled twice is good only
if all its labels are. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, held_out, is_held_out, read_table

TRAIN_DOCS = 1500
TRAIN_LINES = 256
ROUNDS = 3
STEPS = 120
RIDGE = 1e-3
THRESHOLD = 0.3

SPACE, LOWER, UPPER, DIGIT, POINT, SYMBOL, NEWLINE = range(7)


def _classes() -> np.ndarray:
    table = np.full(0x250, SYMBOL, np.uint8)
    for i in range(0x250):
        c = chr(i)
        if c == "\n":
            table[i] = NEWLINE
        elif c.isspace():
            table[i] = SPACE
        elif c.isdigit():
            table[i] = DIGIT
        elif c.isupper():
            table[i] = UPPER
        elif c.isalpha():
            table[i] = LOWER
        elif c in ".,;:'\"-()?":
            table[i] = POINT
    table[0x24F] = LOWER  # and all beyond
    return table


CLASS = _classes()
OWN = 16
#: Own features, those of the line before and after (the first is the bias), and whether there is one.
N_FEATURES = 1 + 3 * OWN + 2


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines x N_FEATURES) features and the lines' lengths in characters, at least 1."""
    lines = text.split("\n")
    codes = np.frombuffer((text + "\n").encode("utf-32-le"), "<u4")
    kind = CLASS[np.minimum(codes, 0x24F)]
    starts = np.flatnonzero(np.append(True, kind[:-1] == NEWLINE))
    n = np.diff(np.append(starts, len(kind))) - 1.0
    lower, upper, digit, point, symbol = (np.add.reduceat(kind == k, starts, dtype=np.float64) for k in (LOWER, UPPER, DIGIT, POINT, SYMBOL))
    size = np.maximum(n, 1)
    letters = np.maximum(lower + upper, 1)
    own = np.zeros((len(lines), OWN))
    seen: dict[str, int] = {}
    for line in lines:
        seen[line] = seen.get(line, 0) + 1
    for i, line in enumerate(lines):
        words = line.split()
        k = len(words)
        if k:
            own[i, 8] = len(set(words)) / k
            own[i, 9] = sum(map(eq, words, words[1:])) / k
            own[i, 10] = min(k, 40) / 40
            own[i, 11] = line[-1] in ".!?" if line else 0
            own[i, 12] = min(n[i] / k, 20) / 20
            own[i, 13] = line.count("|") / k
        own[i, 14] = seen[line] > 1
        own[i, 15] = k < 3
    own[:, 0] = upper / letters
    own[:, 1] = own[:, 0] > 0.4
    own[:, 2] = symbol / size
    own[:, 3] = symbol > 0.08 * size
    own[:, 4] = digit / size
    own[:, 5] = point / size
    own[:, 6] = np.log1p(n) / 6
    own[:, 7] = (lower + upper) / size
    x = np.zeros((len(lines), N_FEATURES))
    x[:, 0] = 1
    x[:, 1 : 1 + OWN] = own
    x[1:, 1 + OWN : 1 + 2 * OWN] = own[:-1]
    x[:-1, 1 + 2 * OWN : 1 + 3 * OWN] = own[1:]
    x[0, -2] = 1
    x[-1, -1] = 1
    return x, size


def marginals(emit: list[float], stay: float, lean: float) -> list[float]:
    """Probability of good for each line. ``emit``: score of good over bad; ``stay``: of equal neighbours; ``lean``: of two good ones.

    Messages are kept as good-to-bad log-odds, so nothing under- or overflows.
    """
    a, b, c = lean + stay, 0.0, stay  # good-good, mixed, bad-bad

    def passed(m: float) -> float:
        return _log_add(a + m, b) - _log_add(b + m, c)

    n = len(emit)
    forward = [0.0] * n
    for i in range(1, n):
        forward[i] = passed(forward[i - 1] + emit[i - 1])
    back, out = 0.0, [0.0] * n
    for i in range(n - 1, -1, -1):
        m = forward[i] + emit[i] + back
        out[i] = 1 / (1 + math.exp(-m)) if m > -700 else 0.0
        back = passed(back + emit[i])
    return out


def _log_add(x: float, y: float) -> float:
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


@dataclass
class Field:
    weight: np.ndarray
    stay: float
    lean: float
    slope: float = 1.0
    offset: float = 0.0

    def lines(self, text: str) -> tuple[list[float], np.ndarray]:
        x, size = line_features(text)
        return marginals((x @ self.weight).tolist(), self.stay, self.lean), size

    def raw(self, text: str) -> float:
        """Logit of the length-weighted mean marginal."""
        p, size = self.lines(text)
        q = min(max(float(np.dot(p, size) / size.sum()), 1e-6), 1 - 1e-6)
        return math.log(q / (1 - q))

    def score(self, text: str) -> float:
        z = self.slope * self.raw(text) + self.offset
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))


class Batch:
    """Padded documents, longest first, for vectorised forward-backward."""

    def __init__(self, docs: list[np.ndarray]):
        self.order = sorted(range(len(docs)), key=lambda i: -len(docs[i]))
        self.length = np.array([len(docs[i]) for i in self.order])
        self.x = np.concatenate([docs[i] for i in self.order])
        self.at = np.cumsum(self.length) - self.length
        self.alive = [int(np.searchsorted(-self.length, -t, "left")) for t in range(int(self.length.max()))]  # documents with a line t

    def step(self, weight: np.ndarray, stay: float, lean: float, target: np.ndarray) -> tuple[np.ndarray, float, float, np.ndarray]:
        """Gradient of the log-likelihood of ``target`` (soft good labels) and the marginals."""
        emit = self.x @ weight
        n, alive, at = len(self.length), self.alive, self.at
        pair = np.array([[stay, 0.0], [0.0, stay + lean]])  # [left][right], bad first
        fwd, bwd = np.zeros((len(emit), 2)), np.zeros((len(emit), 2))
        for t in range(1, len(alive)):
            k = alive[t]
            i = at[:k] + t
            m = fwd[i - 1] + np.stack([np.zeros(k), emit[i - 1]], 1)
            f = np.logaddexp(m[:, :1] + pair[0], m[:, 1:] + pair[1])
            fwd[i] = f - f[:, :1]
        for t in range(len(alive) - 1, 0, -1):
            k = alive[t]
            i = at[:k] + t
            m = bwd[i] + np.stack([np.zeros(k), emit[i]], 1)
            b = np.logaddexp(m[:, :1] + pair[:, 0], m[:, 1:] + pair[:, 1])
            bwd[i - 1] = b - b[:, :1]
        z = fwd + bwd
        p = 1 / (1 + np.exp(-np.clip(z[:, 1] - z[:, 0] + emit, -500, 500)))
        right = np.ones(len(emit), bool)
        right[at] = False
        j = np.flatnonzero(right)
        joint = (fwd[j - 1] + np.stack([np.zeros(len(j)), emit[j - 1]], 1))[:, :, None] + pair + (bwd[j] + np.stack([np.zeros(len(j)), emit[j]], 1))[:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        joint /= joint.sum((1, 2), keepdims=True)
        a, b = target[j - 1], target[j]
        both = a * b
        g_stay = float((both + (1 - a) * (1 - b) - joint[:, 0, 0] - joint[:, 1, 1]).sum())
        g_lean = float((both - joint[:, 1, 1]).sum())
        return self.x.T @ (target - p), g_stay, g_lean, p


def fit_field(docs: list[np.ndarray], sizes: list[np.ndarray], labels: np.ndarray) -> Field:
    """Learn the field and the curve from documents' line features."""
    batch = Batch(docs)
    label = np.repeat(labels[batch.order].astype(float), batch.length)
    # both kinds of document weigh alike
    target = np.where(label == 1, 0.98, 0.02)
    theta = np.zeros(N_FEATURES + 2)
    p = None
    for r in range(ROUNDS):
        if r:  # a bad document's lines that look good are good
            target = np.where(label == 1, 0.98, np.where(p > 0.5, p, 0.02))
        first, second = np.zeros_like(theta), np.zeros_like(theta)
        for step in range(1, STEPS + 1):
            gw, gs, gl, p = batch.step(theta[:-2], theta[-2], theta[-1], target)
            g = np.append(gw, [gs, gl]) / len(label) - RIDGE * theta
            first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
            theta = theta + 0.2 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    field = Field(theta[:-2], float(theta[-2]), float(theta[-1]))
    raw = np.empty(len(docs))
    for i, (x, size) in enumerate(zip(docs, sizes)):
        q = np.clip(np.dot(marginals((x @ field.weight).tolist(), field.stay, field.lean), size) / size.sum(), 1e-6, 1 - 1e-6)
        raw[i] = np.log(q / (1 - q))
    # the curve passes the threshold where the labels are told apart best
    order = np.argsort(raw, kind="stable")
    good = labels[order] == 1
    right = np.cumsum(~good) / max((~good).sum(), 1) + (good.sum() - np.cumsum(good)) / max(good.sum(), 1)
    at = int(np.argmax(right))
    cut = float(raw[order][at : at + 2].mean())
    spread = max(float(np.abs(raw - cut).mean()), 1e-3)
    field.slope = 3 / spread
    field.offset = math.log(THRESHOLD / (1 - THRESHOLD)) - field.slope * cut
    return field


def fit(documents: DataFrame, labels: DataFrame) -> Field | None:
    """The field, or None unless both labels have training rows."""
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    picks = [marked.filter(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS) for q in (0, 1)]
    # at most 2 * TRAIN_DOCS ids meet the documents, so no text of another document is moved
    chosen = documents.select("doc_id", "text").join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id").filter(F.col("text").isNotNull())
    short = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) < TRAIN_LINES
    sampled = chosen.filter(short).groupBy("doc_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality"))

    def rows(texts, quality):
        for text, q in zip(texts, quality):
            x, size = line_features(text)
            yield x.astype("<f4").tobytes(), size.astype("<f4").tobytes(), q

    sample = arrow_map(sampled.select("text", "quality"), rows, "x binary, size binary, quality int").collect()
    label = np.array([r.quality for r in sample])
    if len(set(label.tolist())) < 2:
        return None
    docs = [np.frombuffer(r.x, "<f4").reshape(-1, N_FEATURES).astype(float) for r in sample]
    return fit_field(docs, [np.frombuffer(r.size, "<f4").astype(float) for r in sample], label)


def quality(documents: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines, bad_lines) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(field)

    def rows(ids, texts):
        f = shared.value
        for i, text in zip(ids, texts):
            if f is None:
                yield i, is_held_out(i), 0.5, 1, (text or "").count("\n") + 1, 0
                continue
            p, size = f.lines(text or "")
            q = min(max(float(np.dot(p, size) / size.sum()), 1e-6), 1 - 1e-6)
            z = f.slope * math.log(q / (1 - q)) + f.offset
            score = 1 / (1 + math.exp(-max(-700.0, min(700.0, z))))
            yield i, is_held_out(i), score, int(score >= THRESHOLD), len(p), sum(v < 0.5 for v in p)

    return arrow_map(documents.select("doc_id", "text"), rows, "doc_id long, held_out boolean, score double, predicted int, n_lines long, bad_lines long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    documents = read_table(spark, sf_dir, "documents")
    return quality(documents, fit(documents, read_table(spark, sf_dir, "labels")))
