"""Toxicity by maximum-scoring segments over token log-odds.

* Token scores: log-odds of toxic against other labelled documents with an
  informative Dirichlet prior (Monroe, Colaresi and Quinn, "Fightin' Words",
  2008). A token counts only where its z-score is significant; every other
  token costs a little, so that a passage must earn its length.
* Passages: every maximal-scoring segment in linear time (Ruzzo and Tompa, 1999).
* Calibration: the best segment of a clean text of n tokens follows an
  extreme-value law, P(S >= s) = 1 - exp(-K n exp(-lambda s)) (Karlin and
  Altschul, 1990); lambda and K are fitted to clean documents. Evidence is added
  up over the significant segments, and its log is mapped to a probability by a
  logistic curve. Law and curve are cross-fitted: a training document is scored
  with the token scores of the other folds, so they see what scoring sees.

Training reads at most ``max_docs`` labelled documents, those with the smallest
hash of their id, a bounded sample, in which a word counts at most ``BURST`` times a
document; scoring reads all texts. Executors count words and score the sample; the
driver gets counts and scores, no texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import Scratch, documents, slices

#: Labelled documents that the model is fitted to, at most.
MAX_DOCS = 6_000
TOKEN = re.compile(r"[^\W\d_]+")
#: Of a word's occurrences in one training document, so many count: bursts tell little.
BURST = 3
FOLDS = 3
#: A passage as good as this comes up in so many clean texts of the length, at most, or counts for nothing.
LEVEL = 0.01
#: A word that has no score of its own takes that of its first letters.
PREFIX, STEM = "^", 5


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall((text or "").lower())


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments as (start, end, score), left to right, in linear time.

    Candidates are kept with the sums before and after them; a new positive score
    is merged with the last candidate that starts lower, as long as it also ends
    lower (Ruzzo and Tompa).
    """
    found: list[list[float]] = []  # start, end, sum before, sum after, index of the last candidate with a lower start
    total = 0.0
    for i, s in enumerate(scores):
        before, total = total, total + s
        if s <= 0:
            continue
        a, b, low, high = i, i + 1, before, total
        j = len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = int(found[j][4])
            if j < 0 or found[j][3] >= high:
                break
            a, low = int(found[j][0]), found[j][2]
            del found[j:]
            j -= 1
        found.append([a, b, low, high, j])
    return [(int(x[0]), int(x[1]), x[3] - x[2]) for x in found]


@dataclass
class Model:
    """What training leaves: scores of significant tokens, the null law and the logistic curve."""

    weights: dict[str, float] = field(default_factory=dict)
    rest: float = -0.05
    lam: float = 1.0
    k: float = 0.1
    base: float = 0.01
    curve: tuple[float, float] | None = None
    seen: dict[str, float] = field(default_factory=dict, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"seen": {}}

    def scores(self, words: list[str]) -> list[float]:
        known, weights, rest = self.seen, self.weights, self.rest
        out, last = [], None
        for w in words:
            if w == last:  # a word said again at once adds nothing
                out.append(rest)
                continue
            last = w
            s = known.get(w)
            if s is None:
                s = weights.get(w)
                if s is None:
                    s = weights.get(PREFIX + w[:STEM], rest)
                if len(known) < 200_000:  # a memo, not a limit: other words are looked up again
                    known[w] = s
            out.append(s)
        return out

    def found(self, text: str | None) -> tuple[list[tuple[int, int, float]], int]:
        """All maximal-scoring segments and the number of tokens."""
        words = tokens(text)
        scores = self.scores(words)
        return (segments(scores) if words and max(scores) > 0 else []), len(words)

    def surprise(self, score: float, n: int) -> float:
        """-log10 of the chance that a clean text of n tokens has a segment as good; 0 if it is not significant."""
        p = -math.expm1(-self.k * n * math.exp(-min(self.lam * score, 600.0)))
        return -math.log10(max(p, 1e-250)) if p < LEVEL else 0.0

    def evidence(self, text: str | None) -> tuple[float, list[tuple[int, int, float]], int]:
        """The sum of the passages' surprise, the significant passages, and the number of tokens."""
        found, n = self.found(text)
        kept = [(x, y) for x in found if (y := self.surprise(x[2], n))]
        return sum(y for _, y in kept), [x for x, _ in kept], n

    def probability(self, surprise: float) -> float:
        a, b = self.curve or (0.0, math.log(max(self.base, 1e-6) / max(1 - self.base, 1e-6)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a * math.log1p(surprise) + b))))

    def score(self, text: str | None) -> float:
        return self.probability(self.evidence(text)[0])


def units(text: str | None) -> Counter:
    """The words of a text and their first letters, each at most BURST times."""
    out: Counter = Counter()
    for w, n in Counter(tokens(text)).items():
        out[w] += min(n, BURST)
        out[PREFIX + w[:STEM]] += min(n, BURST)
    return out


def weigh(counts: dict[str, tuple[int, int, int]], n1: int, n0: int, min_z: float = 3.0, min_odds: float = 1.0, prior: float = 200.0) -> dict[str, float]:
    """Scores of units from ``(count in toxic texts, count in others, toxic texts with it)`` and the words counted in either class."""
    out = {}
    for unit, (a, b, within) in counts.items():
        if within < 4 or not n1 or not n0:
            continue
        alpha = 0.5 + prior * (a + b) / (n1 + n0)
        odds = math.log((a + alpha) / max(n1 + prior - a - alpha, 0.5)) - math.log((b + alpha) / max(n0 + prior - b - alpha, 0.5))
        if odds >= min_odds and odds / math.sqrt(1 / (a + alpha) + 1 / (b + alpha)) >= min_z:
            out[unit] = odds
    return out


def calibrate(weights: dict[str, float], scored: list[tuple[int, int, list[float]]]) -> Model:
    """The model with these weights, its law and curve from ``(label, tokens, scores of the segments)`` of cross-fitted documents."""
    m = Model(weights, -0.05 if weights else -1.0, base=sum(y for y, *_ in scored) / max(1, len(scored)))
    # the extreme-value law of the best segment in clean texts, by moments of S - ln(n) / lambda
    clean = [(max(found, default=0.0), n) for y, n, found in scored if not y and n]
    positive = [s for s, _ in clean if s > 0]
    total = float(sum(n for _, n in clean)) or 1.0
    if len(positive) >= 10:
        low = min(positive)
        m.lam = 1.0 / max(0.2, float(np.mean(positive)) - low)
        m.k = len(positive) / total * math.exp(m.lam * low)
    else:
        m.lam, m.k = 1.0, (len(positive) + 0.5) / total
    x = np.array([sum(m.surprise(s, n) for s in found) for _, n, found in scored])
    y = np.array([float(label) for label, *_ in scored])
    # logistic curve by Newton steps with a weak ridge; the slope stays positive
    design, w = np.c_[np.log1p(x), np.ones(len(x))], np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        h = design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        w = w + np.linalg.solve(h, design.T @ (y - p) - 1e-3 * w)
    m.curve = (max(float(w[0]), 1e-3), float(w[1]))
    return m


def _models(counts: dict[str, list[tuple[int, int, int]]], sizes: list[tuple[int, int]]) -> tuple[dict[str, float], list[Model]]:
    """The scores from all folds, and for each fold a model with those from the others; ``counts`` and ``sizes`` are by fold."""
    every = weigh({u: tuple(map(sum, zip(*x))) for u, x in counts.items()}, *map(sum, zip(*sizes)))
    others = []
    for f in range(FOLDS):
        rest = [k for k in range(FOLDS) if k != f]
        others.append(Model(weigh({u: tuple(sum(x[k][j] for k in rest) for j in range(3)) for u, x in counts.items()}, *(sum(sizes[k][j] for k in rest) for j in range(2)))))
    return every, others


def fit(rows: list[tuple[str | None, int]]) -> Model:
    """Fit to (text, label) rows, dealt to folds in turn; without both classes, a model that finds nothing."""
    d1 = sum(1 for _, y in rows if y)
    if not d1 or d1 == len(rows):
        return Model(base=d1 / max(1, len(rows)))
    counts: dict[str, list[tuple[int, int, int]]] = {}
    sizes = [[0, 0] for _ in range(FOLDS)]
    for k, (text, label) in enumerate(rows):
        for u, n in units(text).items():
            own = counts.setdefault(u, [(0, 0, 0)] * FOLDS)
            a, b, c = own[k % FOLDS]
            own[k % FOLDS] = (a + n, b, c + 1) if label else (a, b + n, c)
            if u[0] != PREFIX:
                sizes[k % FOLDS][0 if label else 1] += n
    every, others = _models(counts, sizes)
    found = [others[k % FOLDS].found(text) for k, (text, _) in enumerate(rows)]
    return calibrate(every, [(int(y), n, [s for *_, s in x]) for (_, y), (x, n) in zip(rows, found)])


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text leaves 1 modulo 3 (null ids count as trained-on but carry no label)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on labelled rows outside the held-out third; of more than ``max_docs`` ids, those with the smallest hash.

    Rows of documents that share a labelled id are training rows each. What comes
    to the driver are the counts of units that four toxic texts have, and of each
    training row its label, length and segment scores.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
    few = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(few), "doc_id")
    sample = Scratch(docs.sparkSession, "toxic").table(sample.select(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(FOLDS)).cast("int").alias("fold"), (F.col("toxic") > 0).cast("int").alias("label"), "text"), "sample")

    def listed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            rows = [(f, y, u, n) for f, y, t in zip(*[batch.column(k).to_pylist() for k in range(3)]) for u, n in units(t).items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.string(), pa.int64()))], ["fold", "label", "unit", "n"])

    each = sample.mapInArrow(listed, "fold int, label int, unit string, n long")
    own = lambda f, y: (F.col("fold") == f) & (F.col("label") == y)
    sums = [F.array(*[F.sum(F.when(own(f, 1), F.col("n")).otherwise(0)), F.sum(F.when(own(f, 0), F.col("n")).otherwise(0)), F.sum(F.when(own(f, 1), 1).otherwise(0))]).alias(f"f{f}") for f in range(FOLDS)]
    by_unit = Scratch(docs.sparkSession, "toxic").table(each.groupBy("unit").agg(*sums), "units")
    words = by_unit.where(~F.col("unit").startswith(PREFIX)).agg(*[F.sum(F.col(f"f{f}")[j]) for f in range(FOLDS) for j in range(2)]).first()
    sizes = [(words[2 * f] or 0, words[2 * f + 1] or 0) for f in range(FOLDS)]
    shared = by_unit.where(sum(F.col(f"f{f}")[2] for f in range(FOLDS)) >= 4).collect()
    every, others = _models({r["unit"]: [tuple(r[f"f{f}"]) for f in range(FOLDS)] for r in shared}, sizes)

    def scored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            folds = batch.column(0).to_pylist()
            found = [others[f].found(t) for f, t in zip(folds, batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([n for _, n in found], pa.int64()), pa.array([[s for *_, s in x] for x, _ in found], pa.list_(pa.float64()))], ["label", "n", "scores"])

    rows = [(r["label"], r["n"], list(r["scores"])) for r in sample.mapInArrow(scored, "label int, n long, scores array<double>").collect()]
    d1 = sum(y for y, *_ in rows)
    if not d1 or d1 == len(rows):
        return Model(base=d1 / max(1, len(rows)))
    return calibrate(every, sorted(rows))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score, n_passages, passages ARRAY<STRUCT<first, last, score>>`` for every row of ``docs(doc_id, text)``.

    Null, empty and blank texts have no passages and the score of a text without
    any; texts are read whole; repeated rows and null ids are scored like any
    other; other columns are ignored.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64())]))
        for batch in slices(batches):
            found = [model.evidence(t) for t in batch.column(1).to_pylist()]
            passages = [[{"first": a, "last": b - 1, "score": s} for a, b, s in x[1]] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.probability(x[0]) for x in found], pa.float64()), pa.array(list(map(len, passages)), pa.int32()), pa.array(passages, kind)], ["doc_id", "score", "n_passages", "passages"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, n_passages int, passages array<struct<first: int, last: int, score: double>>")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of every document, learnt from labels outside the held-out third; null and empty texts get that of a text without passages."""
    docs = documents(spark, sf_dir)
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"), "n_passages")
