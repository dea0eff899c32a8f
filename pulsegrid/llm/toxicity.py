"""Operator 10: toxicity by maximum-scoring segments.

Tokens get log-odds of toxic against clean documents with an informative
Dirichlet prior. A linear scan over a text's token scores gives all maximal
scoring segments (every significant passage), and extreme-value statistics
turn the best of them into a p-value for a text of that length, which a
document's score follows.

Learning: all labelled rows outside the held-out fold are used, in one pass;
texts that are equal but for case and white space count once for each label,
and no other row is left out. Each feature (a
word, or its first four or five letters) is counted under 64 bits of hash,
however many there are; counts stay on the executors, and the model holds the
features that lean.

Defined results: a null or empty text has no segment and p-value 1, hence the
lowest score; without any toxic or any clean training row every score is 0;
rows are scored one by one, copies and repeated ids included; rows with a null
id count as held out; a document labelled twice counts as toxic if any label
is. Extra columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, chunks, held_out, is_held_out, materialize, read_table

PREFIXES = (4, 5)
EDGES = " .,;:!?\"'()[]{}|*$%&#-_<>=/\\"
WORDS_KEPT = 250_000
#: Documents' worth of prior for each feature's share.
PRIOR_DOCS = 20.0
#: Twice the log-likelihood ratio by which a feature must lean towards toxic texts (4.5 standard errors).
LEAST_RATIO = 20.0
LEAST_LOG_ODDS = 1.0
#: Costs of a token that doesn't lean, of which learning takes the best.
COSTS = (0.02, 0.05, 0.1, 0.2)


def feature(name: bytes) -> int:
    """64 bits that stand for a feature's name."""
    value = zlib.crc32(name) << 32 | zlib.crc32(name[::-1])
    return value - (value >> 63 << 64)


def names(token: str) -> list[bytes]:
    """A token's features: itself and its prefixes, without case and outer punctuation."""
    word = token.lower().strip(EDGES)
    if not word:
        return []
    return [b"=" + word.encode(), *(b"%d" % n + word[:n].encode() for n in PREFIXES if len(word) >= n)]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score), left to right, in linear time.

    Only runs of positive scores can begin a segment; each keeps the sums
    before and after it, and joins its predecessors while that raises its score.
    """
    total = np.cumsum(scores)
    up = np.flatnonzero(scores > 0)
    if not len(up):
        return []
    first = up[np.append(True, np.diff(up) > 1)]
    last = up[np.append(np.diff(up) > 1, True)]
    found: list[tuple[int, int, float, float]] = []
    lower: list[int] = []  # for each: the nearest one to the left whose left sum is lower, or -1
    for a, b in zip(first.tolist(), last.tolist()):
        left, right = float(total[a] - scores[a]), float(total[b])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = lower[j]
            if j < 0 or found[j][3] >= right:
                found.append((a, b, left, right))
                lower.append(j)
                break
            a, left = found[j][0], found[j][2]
            del found[j:], lower[j:]
    return [(a, b + 1, r - le) for a, b, le, r in found]


@dataclass
class Model:
    """Token log-odds by feature, the cost of other tokens, and the extreme-value parameters."""

    weight: dict[int, float]
    cost: float
    rate: float
    scale: float
    level: float

    def __post_init__(self) -> None:
        self.known: dict[str, float] = {}
        self.prefix: dict[str, float] = {}

    def fresh(self) -> Model:
        """The same model with empty caches, for one task: those of a broadcast model would live as long as its worker."""
        return replace(self)

    def lean(self, name: bytes) -> float:
        return self.weight.get(feature(name), 0.0)

    def leaning(self, token: str) -> float:
        """The largest log-odds of a token's features that lean, or 0. Prefixes are few and kept apart."""
        word = token.lower().strip(EDGES)
        if not word:
            return 0.0
        best = self.lean(b"=" + word.encode())
        for n in PREFIXES:
            if len(word) >= n:
                p = word[:n]
                w = self.prefix.get(p)
                if w is None:
                    if len(self.prefix) > WORDS_KEPT:
                        self.prefix.clear()
                    w = self.prefix[p] = self.lean(b"%d" % n + p.encode())
                best = max(best, w)
        return best

    def leanings(self, text: str) -> np.ndarray:
        """Log-odds of the tokens that lean towards toxic texts, 0 for all others."""
        known, tokens = self.known, text.split()
        try:
            return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))
        except KeyError:
            pass
        if len(known) > WORDS_KEPT:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = self.leaning(t)
        return np.fromiter(map(known.__getitem__, tokens), np.float64, len(tokens))

    def token_scores(self, text: str) -> np.ndarray:
        lean = self.leanings(text)
        lean[lean == 0] = -self.cost
        return lean

    def log_p(self, score: float, tokens: int) -> float:
        """Log of the probability that a clean text of that length has so good a segment."""
        log_e = math.log(self.scale * max(tokens, 1)) - self.rate * score
        return log_e if log_e < -20 else math.log(-math.expm1(-math.exp(min(log_e, 50))) or 1e-300)

    def passages(self, text: str) -> list[tuple[int, int, float]]:
        """Significant segments: token start, token end, log p-value; all of them at the model's level."""
        scores = self.token_scores(text)
        return [(a, b, p) for a, b, s in segments(scores) if (p := self.log_p(s, len(scores))) <= self.level]

    def score(self, text: str) -> float:
        """level / (level + p) for the best segment, so 0.5 where p is at the learnt level."""
        scores = self.token_scores(text)
        best = max((s for _, _, s in segments(scores)), default=None)
        if best is None:
            return 0.0
        return 1 / (1 + math.exp(min(700.0, self.log_p(best, len(scores)) - self.level)))


def log_odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of document counts under the Dirichlet prior of their common shares; twice the log-likelihood ratio."""
    both, every = toxic + clean, n_toxic + n_clean
    share = both / every
    t, c = toxic + PRIOR_DOCS * share, clean + PRIOR_DOCS * share
    delta = np.log(t / (n_toxic + PRIOR_DOCS - t)) - np.log(c / (n_clean + PRIOR_DOCS - c))

    def fits(k, n):
        p = np.clip(k / n, 1e-12, 1 - 1e-12)
        return k * np.log(p) + (n - k) * np.log1p(-p)

    return delta, 2 * (fits(toxic, both) - toxic * math.log(n_toxic / every) - clean * math.log(n_clean / every))


def calibrate(best: np.ndarray, tokens: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Rate and scale of P(best < s) = exp(-scale * length * exp(-rate * s)) from clean texts' best segments.

    ``n`` texts have a value of ``best`` each, and ``tokens`` together. The rate
    is the tail's (texts without a segment censor the lower end), the scale then
    matches the share of texts beyond the tail's start.
    """
    if not len(best):
        return 1.0, 1.0
    order = np.argsort(best, kind="stable")
    best, n, every = best[order], n[order], max(float(tokens.sum()), 1.0)
    start = max(float(best[np.searchsorted(np.cumsum(n), 0.9 * n.sum())]), 1e-6)
    tail = best >= start
    if not tail.any():  # no clean text has a segment: as if one had
        return 1.0, 1 / every
    rate = 1 / max(float(np.average(best[tail] - start, weights=n[tail])), 0.05)
    return rate, float(n[tail].sum()) / every * math.exp(min(rate * start, 500))


def leanings(text_rows: DataFrame) -> dict[int, float]:
    """Hashes of features that lean towards toxic texts with their log-odds, from (text, toxic)."""

    def run(batches):
        import pyarrow as pa

        known: dict[str, bytes] = {}
        for part in (p for batch in batches for p in chunks(batch, 2048)):
            found: tuple[list, list] = ([], [])
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tokens = set(text.split())
                if len(known) > WORDS_KEPT // 2:
                    known.clear()
                for t in tokens:
                    if t not in known:
                        known[t] = np.array([feature(name) for name in names(t)], "<i8").tobytes()
                found[0 if toxic else 1].append(np.unique(np.frombuffer(b"".join(map(known.__getitem__, tokens)), "<i8")))
            for k in (0, 1):
                if found[k]:
                    features, n = np.unique(np.concatenate(found[k]), return_counts=True)
                    none = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(features), *map(pa.array, (n, none) if k == 0 else (none, n))], names=["feature", "toxic", "clean"])

    size = dict(text_rows.groupBy("toxic").count().collect())
    n_toxic, n_clean = size.get(1, 0), size.get(0, 0)
    if not n_toxic or not n_clean:
        return {}
    counts = text_rows.mapInArrow(run, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))

    def lean(frames):
        for f in frames:
            delta, ratio = log_odds(f["toxic"].to_numpy(float), f["clean"].to_numpy(float), n_toxic, n_clean)
            yield f.assign(delta=delta)[(ratio >= LEAST_RATIO) & (delta >= LEAST_LOG_ODDS)][["feature", "delta"]]

    # those that lean alone come to the driver
    often = counts.filter("toxic >= 3").filter(F.col("toxic") * F.lit(n_clean) > F.col("clean") * F.lit(n_toxic))
    found = often.mapInPandas(lean, "feature long, delta double").toPandas()
    return dict(zip(found["feature"].tolist(), found["delta"].tolist()))


def text_digest(text: Column) -> Column:
    """256-bit digest of a text, without its case and with white space collapsed."""
    return F.unhex(F.sha2(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")), 256))


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold; equal texts once for each label.

    Digests, not texts, are compared, and only then are the chosen texts
    fetched, by one shuffle of the texts at any size.
    """
    marked = labels.filter(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("boolean").cast("int")).alias("toxic"))
    usable = documents.filter(F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", text_digest(F.col("text")).alias("digest"), "text")
    chosen = usable.select("doc_id", "digest").join(marked, "doc_id").groupBy("digest", "toxic").agg(F.min("doc_id").alias("doc_id"))
    fetched = usable.join(chosen.hint("merge"), ["doc_id", "digest"])
    # rows with one id and equal texts
    return fetched.groupBy("doc_id", "digest", "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def fit(documents: DataFrame, labels: DataFrame) -> Model | None:
    """The model, or None where a label has no training rows."""
    train = materialize(training_rows(documents, labels), "toxicity-train")
    weight = leanings(train)
    if not weight:
        return None
    shared = documents.sparkSession.sparkContext.broadcast(Model(weight, 0.0, 1.0, 1.0, 0.0))

    own: list[Model] = []

    def rows(texts, toxic):
        if not own:
            own.append(shared.value.fresh())
        m = own[0]
        for text, label in zip(texts, toxic):
            lean = m.leanings(text)
            for k, cost in enumerate(COSTS):
                scores = np.where(lean > 0, lean, -cost)
                yield k, label, round(max((s for _, _, s in segments(scores)), default=0.0), 3), len(scores)

    # a histogram of at most a few thousand cells, not rows: log2 of the length in quarters, score in tenths, and beyond 60 in hundredths of its logarithm
    fine, coarse = F.round(F.col("best") * 10) / 10, F.exp(F.round(F.log(F.greatest("best", F.lit(1.0))) * 100) / 100)
    cells = (
        arrow_map(train, rows, "k int, toxic int, best double, tokens long")
        .withColumn("cell", F.floor(F.log2(F.col("tokens") + 1) * 4))
        .withColumn("best", F.when(F.col("best") < 60, fine).otherwise(coarse))
        .groupBy("k", "toxic", "best", "cell")
        .agg(F.count("*").alias("n"), F.sum("tokens").alias("tokens"))
        .toPandas()
    )
    fits = []
    for k, cost in enumerate(COSTS):
        part = cells[cells.k == k]
        clean, toxic = part[part.toxic == 0], part[part.toxic == 1]
        rate, scale = calibrate(*(clean[c].to_numpy(float) for c in ("best", "tokens", "n")))
        m = Model(weight, cost, rate, scale, 0.0)
        p, n, y = (np.array(x) for x in zip(*[(m.log_p(b, t / n) if b > 0 else 0.0, n, y) for b, t, n, y in zip(part.best, part.tokens, part.n, part.toxic)]))
        order = np.argsort(p, kind="stable")
        # the level at which the labels are told apart with the best F1
        hit, wrong = np.cumsum((n * y)[order]), np.cumsum((n * (1 - y))[order])
        f1 = 2 * hit / (hit + wrong + (n * y).sum())
        f1[np.append(np.diff(p[order]) == 0, False)] = 0
        at = int(np.argmax(f1))
        after = p[order][at + 1] if at + 1 < len(order) else p[order][at]
        fits.append((float(f1[at]), -k, Model(weight, cost, rate, scale, float((p[order][at] + after) / 2))))
    return max(fits, key=lambda x: x[:2])[2]


def toxicity(documents: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, worst_log_p) of every whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    own: list[Model | None] = []

    def rows(ids, texts):
        if not own:
            own.append(shared.value and shared.value.fresh())
        m = own[0]
        for i, text in zip(ids, texts):
            text = text or ""
            score = m.score(text) if m else 0.0
            found = m.passages(text) if m else []
            yield i, is_held_out(i), score, int(score >= threshold), len(found), min((p for _, _, p in found), default=None)

    return arrow_map(documents.select("doc_id", "text"), rows, "doc_id long, held_out boolean, score double, predicted int, n_passages int, worst_log_p double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    documents = read_table(spark, sf_dir, "documents")
    return toxicity(documents, fit(documents, read_table(spark, sf_dir, "labels")))


def without_toxic(documents: DataFrame, model: Model | None, threshold: float = 0.5) -> DataFrame:
    """The rows whose score is below the threshold, with all their columns; decided where they are read."""
    import pyarrow as pa

    shared = documents.sparkSession.sparkContext.broadcast(model)
    at = documents.columns.index("text")

    def run(batches):
        m = shared.value and shared.value.fresh()
        for batch in batches:
            texts = (t for part in chunks(batch.select([at]), 512) for t in part.column(0).to_pylist())
            yield batch.filter(pa.array([not m or m.score(t or "") < threshold for t in texts], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
