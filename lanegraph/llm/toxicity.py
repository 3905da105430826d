"""Toxic passages by maximum-scoring segments over token log-odds.

Training. Documents of a bounded labelled sample are counted per feature (words and word
beginnings) and class; a feature's score is its log-odds under an informative Dirichlet prior
(the pooled frequencies, worth ``prior_share`` of the observations), kept where it is clear of its
own variance. At most ``max_features`` scores form the model. On a second fold the best
segments of clean documents give the extreme-value line ln E = ln n + a - lambda S, and a
logistic fit over binned document statistics turns E-values into probabilities.

Scoring. One linear scan per document: words without a clear score cost ``gap``; all maximal
scoring segments are found in one pass over the positive words (each is looked at a constant
number of times); every segment with E < 1 is a passage, and a document's statistic adds the
-ln E of its passages. Documents are read once, in place, and never shuffled.

Defined cases: null, empty or wordless text has no segment and takes the score of that; texts
of any length are scanned whole; a sample of one label alone gives every document a score on
its side, an empty one a low score; repeated and equal documents are scored alike; of features
tied at the end of the model the first by name stay; labelled rows repeated under one key
count once, toxic if any says so; an empty table gives no rows; other columns pass through,
but score and passages are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import map_rows
from lanegraph.stage import discard, materialize

WORD = re.compile(r"[^\W_]+")
BEGINNINGS = (4, 5, 6)


@dataclass
class Model:
    """Scores of features, the extreme-value line, and the logistic calibration."""

    scores: dict[str, float] = field(default_factory=dict)
    gap: float = 0.25
    intercept: float = 0.0
    decay: float = 1.0
    slope: float = 0.0
    offset: float = -2.0


class _Scorer(dict):
    """word -> score: its own, else its longest scored beginning's, else minus the gap."""

    def __init__(self, model: Model, most: int = 300_000):
        super().__init__()
        self.model, self.most = model, most

    def __missing__(self, word: str) -> float:
        scores = self.model.scores
        value = scores.get(word)
        if value is None:
            for n in reversed(BEGINNINGS):
                if len(word) >= n and (value := scores.get(f"{word[:n]}*")) is not None:
                    break
        value = -self.model.gap if value is None else value
        if len(self) >= self.most:
            self.clear()
        self[word] = value
        return value


def features(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    return words | {f"{w[:n]}*" for w in words for n in BEGINNINGS if len(w) >= n}


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end exclusive, score), left to right, in linear time."""
    total = np.concatenate(([0.0], np.cumsum(scores)))
    up = np.flatnonzero(scores > 0)
    found: list[list[float]] = []  # start, end, sum before, sum after, link to the nearest smaller sum before
    for i in up:
        cur = [int(i), int(i) + 1, total[i], total[i + 1], -1]
        while True:
            j = cur[4] if cur[4] != -1 else len(found) - 1
            while j >= 0 and found[j][2] >= cur[2]:
                j = found[j][4] if found[j][4] != -2 else -1
            if j < 0:
                cur[4] = -2
                found.append(cur)
                break
            if found[j][3] >= cur[3]:
                cur[4] = j
                found.append(cur)
                break
            cur = [found[j][0], cur[1], found[j][2], cur[3], found[j][4]]
            del found[j:]
            if cur[4] == -2:
                found.append(cur)
                break
    return [(s, e, float(after - before)) for s, e, before, after, _ in found]


def _scan(text: str, scorer: _Scorer) -> tuple[int, list[tuple[int, int, float]]]:
    words = WORD.findall(text.lower())
    return len(words), segments(np.fromiter(map(scorer.__getitem__, words), float, len(words)))


def _log_e(model: Model, n: int, score: float) -> float:
    return math.log(max(n, 1)) + model.intercept - model.decay * score


def _statistic(model: Model, n: int, found: list[tuple[int, int, float]]) -> tuple[float, list[tuple[int, int, float, float]]]:
    """-ln E of the best segment plus those of the other significant ones; the passages."""
    if not found:
        return -20.0, []
    logs = [_log_e(model, n, s) for _, _, s in found]
    best = min(logs)
    passages = [(a, b, s, e) for (a, b, s), e in zip(found, logs, strict=True) if e < 0]
    return max(-20.0, -best + (sum(-e for *_, e in passages) + best if passages else 0.0)), passages


def _texts(batch: pa.RecordBatch, column: str) -> list[str]:
    return [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, key: str = "doc_id", text: str = "text", at_most: int = 30_000) -> DataFrame:
    """Texts and labels of at most ``at_most`` labelled rows, chosen by a hash of the key.

    The choice is made on keys alone and broadcast (its size is ``at_most`` rows of two
    numbers), so documents are filtered where they are read.
    """
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("label"))
    chosen = one.orderBy(F.xxhash64(key), key).limit(at_most)
    return materialize(docs.select(key, text).join(F.broadcast(chosen), key), "labelled")


def _feature_counts(sample: DataFrame, text: str) -> DataFrame:
    """feature, toxic, clean: documents that have it."""

    def run(batches):
        sums: tuple[Counter, Counter] = (Counter(), Counter())

        def rows():
            both = list(sums[0].keys() | sums[1].keys())
            out = pa.RecordBatch.from_arrays(
                [pa.array(both, pa.string()), pa.array([sums[1][k] for k in both], pa.int64()), pa.array([sums[0][k] for k in both], pa.int64())],
                names=["feature", "toxic", "clean"],
            )
            sums[0].clear(), sums[1].clear()
            return out

        for b in batches:
            for t, y in zip(_texts(b, text), b.column(b.schema.get_field_index("label")).to_pylist(), strict=True):
                sums[bool(y)].update(features(t))
                if len(sums[0]) + len(sums[1]) > 400_000:
                    yield rows()
        yield rows()

    return sample.select(text, "label").mapInArrow(run, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def train(sample: DataFrame, key: str = "doc_id", text: str = "text", prior_share: float = 0.3, clear: float = 3.0, max_features: int = 50_000) -> Model:
    """Fit a Model on labelled_sample() rows; four fifths of them score, one fifth calibrates."""
    fold = F.pmod(F.xxhash64(F.lit("fold"), key), F.lit(5))
    sizes = {r["label"]: r["n"] for r in sample.filter(fold != 0).groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    if not n1 or not n0:
        return Model(offset=5.0 if n1 else -5.0)
    t, c, a = F.col("toxic"), F.col("clean"), F.lit(prior_share) * (F.col("toxic") + F.col("clean"))
    prior_weight = prior_share * (n1 + n0)
    odds = F.log((t + a) / (n1 + prior_weight)) - F.log((c + a) / (n0 + prior_weight))
    counted = _feature_counts(sample.filter(fold != 0), text).filter("toxic + clean >= 4")
    scored = counted.select("feature", odds.alias("s"), (odds / F.sqrt(1 / (t + a) + 1 / (c + a))).alias("z")).filter(F.abs("z") >= clear)
    top = scored.orderBy(F.desc(F.abs("z")), "feature").limit(max_features).collect()
    model = Model({r["feature"]: r["s"] for r in top})
    _calibrate(sample.filter(fold == 0), model, text)
    return model


def _bins(sample: DataFrame, model: Model, text: str, value) -> dict[tuple[int, float], int]:
    """How many documents of each label have each (rounded) value; a few hundred rows."""

    def run(batches):
        scorer, sums = _Scorer(model), Counter()
        for b in batches:
            for t, y in zip(_texts(b, text), b.column(b.schema.get_field_index("label")).to_pylist(), strict=True):
                n, found = _scan(t, scorer)
                sums[int(bool(y)), round(min(max(value(n, found), -50.0), 200.0) * 2) / 2] += 1
        k = list(sums)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in k], pa.int32()), pa.array([x[1] for x in k], pa.float64()), pa.array([sums[x] for x in k], pa.int64())], names=["label", "x", "n"])

    rows = sample.select(text, "label").mapInArrow(run, "label int, x double, n long").groupBy("label", "x").agg(F.sum("n").alias("n")).collect()
    return {(r["label"], r["x"]): r["n"] for r in rows}


def _calibrate(sample: DataFrame, model: Model, text: str) -> None:
    # The tail of best scores less ln n / lambda among clean documents is a line on a log scale.
    best = _bins(sample, model, text, lambda n, found: max((s for *_, s in found), default=0.0) - math.log(max(n, 1)))
    clean = sorted((x, n) for (y, x), n in best.items() if y == 0)
    every = sum(n for _, n in clean)
    tail, above = [], 0
    for x, n in reversed(clean):
        above += n
        if 3 <= above <= every / 2:
            tail.append((x, math.log(above / every), above))
    if len(tail) >= 3:
        x, y, w = (np.array(v, float) for v in zip(*tail, strict=True))
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        slope = np.average((x - mx) * (y - my), weights=w) / max(np.average((x - mx) ** 2, weights=w), 1e-9)
        model.decay = float(min(max(-slope, 0.2), 2.0))
        model.intercept = float(my + model.decay * mx) - (1 - model.decay) * 6.0
    line = _bins(sample, model, text, lambda n, found: _statistic(model, n, found)[0])
    x = np.array([k[1] for k in line]) / 10
    y, w = np.array([k[0] for k in line], float), np.array(list(line.values()), float)
    if y.min(initial=1) == y.max(initial=0):
        model.offset = 5.0 if y.size and y[0] else -5.0
        return
    beta, ridge = np.zeros(2), np.diag([1e-2, 1e-3])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        step = np.linalg.solve((design * (w * p * (1 - p))[:, None]).T @ design + ridge, design.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
    model.slope, model.offset = float(beta[0] / 10), float(beta[1])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score (0 to 1) and passages (word positions, score, ln E)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = sent.value
        scorer = _Scorer(own)
        for b in batches:
            out = {"score": [], "passages": []}
            for t in _texts(b, text):
                n, found = _scan(t, scorer)
                x, passages = _statistic(own, n, found)
                out["score"].append(1 / (1 + math.exp(-min(max(own.slope * x + own.offset, -30), 30))))
                out["passages"].append([{"start": a, "end": e, "score": s, "log_e": g} for a, e, s, g in passages])
            yield out

    return map_rows(docs, run, "score double, passages array<struct<start:int,end:int,score:double,log_e:double>>")


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", at_most: int = 30_000) -> DataFrame:
    """Train on a bounded sample of ``labels`` and score every document."""
    sample = labelled_sample(docs, labels, label, key, text, at_most)
    model = train(sample, key, text)
    discard(sample)
    return score(docs, model, text)
