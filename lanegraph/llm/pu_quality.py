"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text (bounded samples, chosen by a hash of the key)
train a linear model over binned shape statistics of a text. The risk is the non-negative
unbiased one: prior * E_pos[loss(+)] + max(0, E_unl[loss(-)] - prior * E_pos[loss(-)]), with
the gradient of the negative part reversed where it falls below zero. The class prior is
estimated from the same two samples, labels of negatives are never used: where positives
are dense and negatives rare, the share of unlabelled over the share of positives comes down
to the prior, so the least such ratio over the tops of cross-fitted scores is taken.

Scoring reads every document once, in place; the model is a few hundred numbers.

Defined cases: null or empty text has the statistics of no words and is scored like any
other; texts of any length are read whole; without positives or documents every score is
0.5; repeated and equal documents are scored alike; repeated labels of one key count once,
positive only if all say so, and null ones not at all; an empty table gives no rows; other
columns pass through, but score is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import byte_texts, map_rows
from lanegraph.stage import discard, materialize

BINS = 16

_kind = np.zeros(256, np.int64)
for _chars, _k in ((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\r\x0b\x0c", 3), (b".,;:", 4), (b"!?", 5), (b"#*$%&|<>", 6), (b"()[]{}=/\\_-+\"'", 7)):
    _kind[list(_chars)] = _k
_kind[128:] = 8


def statistics(text: bytes) -> list[float]:
    """Shape of a text: shares of character kinds, word lengths, repetition of words, windows and lines."""
    codes = np.bincount(_kind[np.frombuffer(text, np.uint8)], minlength=9).astype(float) if text else np.zeros(9)
    words = text.split()
    n, lines = len(words), [x for x in text.split(b"\n") if x.strip()]
    shares = codes / max(len(text), 1)
    windows = set(zip(words, words[1:], words[2:], strict=False))
    return [
        float(np.log1p(n)),
        *shares[1:9],
        (len(text) - codes[3]) / max(n, 1),
        len(set(words)) / max(n, 1),
        len(windows) / max(n - 2, 1),
        len(set(lines)) / max(len(lines), 1),
        n / max(len(lines), 1),
        codes[5] / max(n, 1),
        codes[6] / max(n, 1),
        (codes[4] + codes[5]) / max(n, 1),
    ]


@dataclass
class Model:
    edges: np.ndarray | None
    weights: np.ndarray | None
    bias: float
    prior: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.bias)
        place = np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(self.edges)], axis=1)
        return self.weights[np.arange(place.shape[1]), place].sum(axis=1) + self.bias


def training_rows(docs: DataFrame, labels: DataFrame, label: str, key: str, text: str, positives: int, unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of the sampled positives and of unlabelled documents.

    The samples' keys are broadcast (at most positives + unlabelled rows of two numbers); what
    reaches the driver is the samples' statistics, a bounded number of short rows.
    """
    one = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(key).agg(F.min(label).cast("int").alias("y"))
    order = [F.xxhash64(F.lit("pu"), key), F.col(key)]
    pos = one.filter("y = 1").orderBy(*order).limit(positives).select(key, F.lit(1).alias("kind"))
    # The unlabelled are drawn from all documents, positives among them, as the risk assumes.
    web = docs.filter(F.col(key).isNotNull()).select(key).orderBy(F.xxhash64(F.lit("web"), key), key).limit(unlabelled).select(key, F.lit(0).alias("kind"))
    chosen = docs.select(key, text).join(F.broadcast(pos.union(web)), key)

    def run(batches):
        for b in batches:
            rows = [statistics(t) for t in byte_texts(b, text)]
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("kind")), pa.array(rows, pa.list_(pa.float64()))], names=["kind", "x"])

    found = materialize(chosen.mapInArrow(run, "kind int, x array<double>"), "pu-statistics")
    got = found.toPandas()
    discard(found)
    width = len(statistics(b""))
    x = {k: np.array([list(r) for r in got["x"][got["kind"] == k]], float).reshape(-1, width) for k in (0, 1)}
    return x[1], x[0]


def estimate_prior(pos: np.ndarray, web: np.ndarray, guess: float = 0.9, seed: int = 5) -> float:
    """Share of positives among the unlabelled, from positives and unlabelled alone.

    Each half is scored by a model of the other halves. Of the unlabelled above a score, as
    many as prior times the positives above it are positive, the rest negative; the least
    ratio of the two shares, over tops that hold 30 to 98 % of the positives, has fewest of
    these (a mean of three neighbouring tops is taken). The guess only orders the scores; what
    is found with it is the guess of a second pass.
    """
    if min(len(pos), len(web)) < 4:
        return 0.5
    rng = np.random.default_rng(seed)
    halves = [np.array_split(rng.permutation(len(x)), 2) for x in (pos, web)]
    for _ in range(2):
        scores = [np.zeros(len(pos)), np.zeros(len(web))]
        for k in (0, 1):
            model = fit(pos[halves[0][k]], web[halves[1][k]], guess, epochs=300)
            for own, x, at in zip(scores, (pos, web), (halves[0][1 - k], halves[1][1 - k]), strict=True):
                own[at] = model.logits(x[at])
        tops = np.quantile(scores[0], 1 - np.arange(0.30, 0.99, 0.02))
        above = [1 - np.searchsorted(np.sort(s), tops, side="right") / len(s) for s in scores]
        ratios = above[1][above[0] > 0] / above[0][above[0] > 0]
        guess = min(1.0, float(np.convolve(ratios, np.full(3, 1 / 3), "valid").min())) if len(ratios) >= 3 else 0.5
    return guess


def fit(pos: np.ndarray, web: np.ndarray, prior: float, epochs: int = 1000, rate: float = 0.05, decay: float = 1e-4, seed: int = 7) -> Model:
    """Minimise the non-negative unbiased risk (logistic loss) by mini-batch Adam; the model is the mean of the second half's."""
    prior = min(max(prior, 0.02), 0.98)
    if not len(pos) or not len(web):
        return Model(None, None, float(np.log(prior / (1 - prior))), prior)
    both = np.concatenate([pos, web])
    edges = np.quantile(both, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T
    extreme = np.quantile(both, [0.005, 0.02, 0.98, 0.995], axis=0).T
    edges = np.sort(np.concatenate([edges, extreme], axis=1), axis=1)
    place = [np.stack([np.searchsorted(e, x[:, k], side="right") for k, e in enumerate(edges)], axis=1) for x in (pos, web)]
    f, b = edges.shape[0], edges.shape[1] + 1
    w, bias, rng = np.zeros((f, b)), 0.0, np.random.default_rng(seed)
    m, v, cols = np.zeros(f * b + 1), np.zeros(f * b + 1), np.arange(f)
    mean_w, mean_bias, half = np.zeros((f, b)), 0.0, epochs // 2
    sigma = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, epochs + 1):
        p = place[0][rng.integers(0, len(pos), min(len(pos), 4096))]
        u = place[1][rng.integers(0, len(web), min(len(web), 4096))]
        zp, zu = w[cols, p].sum(axis=1) + bias, w[cols, u].sum(axis=1) + bias
        loss = lambda z: np.logaddexp(0, z)
        negative = loss(zu).mean() - prior * loss(zp).mean()
        gp = (-prior * sigma(-zp)) / len(p)
        gn_u, gn_p = sigma(zu) / len(u), -prior * sigma(zp) / len(p)
        if negative < 0:
            gp, gn_u, gn_p = np.zeros_like(gp), -gn_u, -gn_p
        grad, gw = np.zeros(f * b + 1), np.zeros((f, b))
        for k in range(f):
            gw[k] = np.bincount(p[:, k], gp + gn_p, b) + np.bincount(u[:, k], gn_u, b)
        grad[:-1], grad[-1] = (gw + decay * w).ravel(), (gp + gn_p).sum() + gn_u.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, bias = w - step[:-1].reshape(f, b), bias - step[-1]
        if t > half:
            mean_w, mean_bias = mean_w + w / (epochs - half), mean_bias + bias / (epochs - half)
    return Model(edges, mean_w, float(mean_bias), prior)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with score: the estimated probability of the positive label."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            x = np.array([statistics(t) for t in byte_texts(b, text)], float).reshape(b.num_rows, -1)
            z = sent.value.logits(x) if b.num_rows else np.zeros(0)
            yield {"score": pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))), pa.float64())}

    return map_rows(docs, run, "score double")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", positives: int = 10_000, unlabelled: int = 20_000) -> DataFrame:
    """Fit on bounded samples and score every document."""
    pos, web = training_rows(docs, labels, label, key, text, positives, unlabelled)
    return score(docs, fit(pos, web, estimate_prior(pos, web)), text)
