"""Exact top-k search by inner product with a pivot table.

Distances from every vector to PIVOTS pivots are computed once and kept. For a query q and a
vector x each pivot p gives |q - x| >= |d(q, p) - d(x, p)|, so with the greatest of these, g,
their inner product is at most (|q|^2 + |x|^2 - g^2) / 2. Candidates are evaluated in the order
of that bound, GROUP at a time, until the k-th best score found lies above all bounds left;
the result is that of comparing all pairs.

Vectors are sorted by their nearest pivot and the distance to it, and packed in blocks of BLOCK
rows, queries in blocks of QUERIES. A block knows the range of its distances to each pivot; a
query block meets a vector block only if the bound between their ranges reaches the least score
that any of its queries still needs. These pairs of blocks are the unit of work: each is one
group with both blocks in memory and nothing else, and gives at most k rows a query, so neither
a task nor the driver sees all vectors or all queries.

Pivots, and for each query a first score that its k-th best must reach, come from a sample of
SAMPLE vectors (those of the least hashes of their ids), the only rows that the driver reads.
The sample decides how much is skipped, never the result.

Defined cases: components are floor(scale * x), x as a double; vectors that are null or hold
null or non-finite components take no part, nor do rows without an id; shorter vectors count as
padded with zeros; of rows that share an id the one whose vector comes first counts, so repeated
rows are one; a query never meets its own id; ties go to the smaller id; scores beyond a long
are cut to its range; an empty table, or one without queries, gives no rows; other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.stage import discard, materialize

TOP, SCALE = 20, 64
PIVOTS, SAMPLE = 32, 2048
#: Rows of a block of vectors and of queries, and candidates evaluated between two looks at the bounds.
BLOCK, QUERIES, GROUP = 4096, 512, 512
#: Lanes over which summaries of blocks meet.
LANES = 64

_PACKED = "block bigint, ids binary, vectors binary, near binary, least binary, low array<double>, high array<double>, norm double, needs double"
_LONG = np.iinfo(np.int64)


def usable(vector: str) -> Column:
    """Vectors without null or non-finite components."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def search(vectors: DataFrame, asks: Column, key: str = "vec_id", vector: str = "embedding", k: int = TOP, scale: int = SCALE) -> DataFrame:
    """query, rank, id, score: the ``k`` best other rows of every row for which ``asks`` (over the column ``id``, the key) holds."""
    parts = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    rows = vectors.filter(F.col(key).isNotNull() & usable(vector)).select(F.col(key).cast("bigint").alias("id"), parts.alias("v"))
    clean = materialize(rows.groupBy("id").agg(F.min("v").alias("v")), "search-vectors")
    dim = clean.agg(F.max(F.size("v"))).first()[0] or 0
    sample = clean.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
    ids, known = np.array([r.id for r in sample], np.int64), _padded([r.v for r in sample], dim)
    pivots = _pivots(known)
    near = materialize(clean.mapInArrow(_to_pivots(pivots, dim), "id bigint, v binary, near binary, cell int, d double"), "search-distances")
    discard(clean)
    every = materialize(_packed(near, dim, len(pivots), BLOCK, None), "search-blocks")
    asked = materialize(_packed(near.filter(asks), dim, len(pivots), QUERIES, (ids, known, k)), "search-queries")
    discard(near)
    pairs = materialize(_meeting(asked, every), "search-pairs")
    payload = ["ids", "vectors", "near"]
    ours = pairs.join(asked.select(F.col("block").alias("q"), *payload, "least"), "q")
    theirs = pairs.join(every.select(F.col("block").alias("x"), *payload), "x").select(F.col("q").alias("xq"), F.col("x").alias("xx"), *payload)
    found = ours.groupBy("q", "x").cogroup(theirs.groupBy("xq", "xx")).applyInArrow(_evaluated(dim, len(pivots), k), "query bigint, id bigint, score bigint")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "id", "score")


def _meeting(asked: DataFrame, every: DataFrame) -> DataFrame:
    """q, x: the pairs of blocks whose bound reaches what the query block needs."""
    q = asked.select(F.col("block").alias("q"), F.pmod(F.xxhash64("block"), F.lit(LANES)).alias("lane"), F.col("low").alias("ql"), F.col("high").alias("qh"), F.col("norm").alias("qn"), "needs")
    x = every.select(F.col("block").alias("x"), F.col("low").alias("xl"), F.col("high").alias("xh"), F.col("norm").alias("xn"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(LANES - 1).cast("bigint"))).alias("lane"))
    apart = lambda a, b: F.zip_with(a, b, lambda lo, hi: F.greatest(lo - hi, F.lit(0.0)))
    gap = F.greatest(F.array_max(apart("ql", "xh")), F.array_max(apart("xl", "qh")))
    # a part in 10^6 more, as distances are rounded
    return q.join(x, "lane").filter((F.col("qn") + F.col("xn")) * 1.000001 + 1 - gap * gap * 0.999999 >= 2 * F.col("needs")).select("q", "x")


def _padded(rows: list, dim: int) -> np.ndarray:
    out = np.zeros((len(rows), dim), np.int64)
    for k, row in enumerate(rows):
        out[k, : len(row)] = row
    return out


def _pivots(sample: np.ndarray) -> np.ndarray:
    """Vectors of the sample, each the farthest from those before it; the first is the farthest from their mean."""
    v = sample.astype(float)
    if not len(v):
        return v
    least, chosen = np.full(len(v), np.inf), []
    at = int(((v - v.mean(0)) ** 2).sum(1).argmax())
    while len(chosen) < min(PIVOTS, len(v)) and least.max() > 0:
        chosen.append(at)
        least = np.minimum(least, ((v - v[at]) ** 2).sum(1))
        at = int(least.argmax())
    return v[chosen]


def _to_pivots(pivots: np.ndarray, dim: int):
    """Adds the packed vector, its distances to the pivots, its nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 4096):
                b = whole.slice(start, 4096)
                v = _unpacked_lists(b.column("v"), dim)
                d = np.sqrt(np.stack([((v - p) ** 2).sum(1) for p in pivots], 1)) if len(v) else np.zeros((0, len(pivots)))
                cell = d.argmin(1) if len(v) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array([x.tobytes() for x in v], pa.binary()), pa.array([x.tobytes() for x in d], pa.binary()), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(v)), cell], pa.float64())],
                    names=["id", "v", "near", "cell", "d"],
                )

    return run


def _unpacked_lists(column: pa.Array, dim: int) -> np.ndarray:
    sizes = column.value_lengths().to_numpy()
    flat = column.flatten().to_numpy()
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    return _padded(np.split(flat, np.cumsum(sizes)[:-1]), dim)


def _packed(near: DataFrame, dim: int, pivots: int, size: int, seed: tuple | None) -> DataFrame:
    """Blocks of ``size`` rows next to one another; with ``seed`` (ids, vectors, k) also the score each query's k-th best must reach."""
    order = ["cell", "d", "id"]
    dealt = near.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "v", "near", F.monotonically_increasing_id().alias("at"))

    def pack(ids: np.ndarray, v: np.ndarray, d: np.ndarray, at: int) -> pa.RecordBatch:
        least = _seeded(ids, v, *seed) if seed else np.zeros(0)
        # squares of the norm as doubles; the bound allows for their rounding
        norm = float((v.astype(float) ** 2).sum(1).max())
        row = [at, ids.tobytes(), v.tobytes(), d.tobytes(), least.tobytes(), d.min(0).tolist(), d.max(0).tolist(), norm, float(least.min()) if len(least) else 0.0]
        names = [x.split()[0] for x in _PACKED.split(", ")]
        kinds = [pa.int64(), *[pa.binary()] * 4, *[pa.list_(pa.float64())] * 2, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in batches:
            for start in range(0, len(whole), size):
                b = whole.slice(start, size)
                held.append(b)
                n += len(b)
                while n >= size:
                    t = pa.Table.from_batches(held)
                    yield cut(t.slice(0, size))
                    held = t.slice(size).to_batches()
                    n -= size
        if n:
            yield cut(pa.Table.from_batches(held))

    def cut(t: pa.Table) -> pa.RecordBatch:
        v = np.frombuffer(b"".join(t["v"].to_pylist()), np.int64).reshape(len(t), dim)
        d = np.frombuffer(b"".join(t["near"].to_pylist())).reshape(len(t), pivots)
        return pack(t["id"].to_numpy(), v, d, t["at"][0].as_py())

    return dealt.mapInArrow(run, _PACKED)


def _products(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``v`` with those of ``q``, cut to the range of a long."""
    most = float(np.abs(v).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(v.shape[1], 1)
    if most < 2**53:
        return (v.astype(float) @ q.T.astype(float)).astype(np.int64)
    exact = v.astype(object) @ q.T.astype(object)
    return np.clip(exact, _LONG.min, _LONG.max).astype(np.int64)


def _seeded(ids: np.ndarray, v: np.ndarray, known_ids: np.ndarray, known: np.ndarray, k: int) -> np.ndarray:
    """Per query its k-th best score in the sample, which its k-th best of all reaches too."""
    scores = _products(known, v).T.astype(float)
    scores[ids[:, None] == known_ids[None, :]] = -np.inf
    if scores.shape[1] < k:
        return np.full(len(ids), -np.inf)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    first = np.lexsort((ids, ~scores))[:k]  # the complement falls as the score rises, and never overflows
    return ids[first], scores[first]


def _evaluated(dim: int, pivots: int, k: int):
    """The best rows of one block for the queries of another, in the order of their bounds until no bound reaches the k-th best."""

    def blocks(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        ids = np.frombuffer(t["ids"][0].as_py(), np.int64)
        v = np.frombuffer(t["vectors"][0].as_py(), np.int64).reshape(len(ids), dim)
        return ids, v, np.frombuffer(t["near"][0].as_py()).reshape(len(ids), pivots)

    def run(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        qid, q, dq = blocks(ours)
        xid, x, dx = blocks(theirs)
        least = np.frombuffer(ours["least"][0].as_py())
        small = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * max(dim, 1) < 2**53
        xf, qf = x.astype(float), q.astype(float)
        nx, nq = (xf * xf).sum(1), (qf * qf).sum(1)
        gap = np.zeros((len(qid), len(xid)), np.float32)
        dx32, dq32 = np.ascontiguousarray(dx.T, np.float32), np.ascontiguousarray(dq.T, np.float32)
        for p in range(pivots):
            np.maximum(gap, np.abs(dq32[p][:, None] - dx32[p][None, :]), out=gap)
        # what the rounding of the distances can take from a gap, or of the norms from their sum
        slack = 4e-6 * max(dx.max(initial=0), dq.max(initial=0)) ** 2 + 1e-9 * (nx.max(initial=0) + nq.max(initial=0)) + 1e-3
        bound = (nq[:, None] + nx[None, :] - gap.astype(float) ** 2) / 2 + slack
        out: list[list[np.ndarray]] = [[], [], []]
        for r in range(len(qid)):
            need = least[r]
            left = np.flatnonzero((bound[r] >= need) & (xid != qid[r]))
            got_id, got = np.zeros(0, np.int64), np.zeros(0, np.int64)
            while len(left):
                if len(left) > GROUP:
                    parted = np.argpartition(-bound[r, left], GROUP)
                    now, left = left[parted[:GROUP]], left[parted[GROUP:]]
                else:
                    now, left = left, left[:0]
                scores = (xf[now] @ qf[r]).astype(np.int64) if small else _products(x[now], q[r : r + 1])[:, 0]
                good = scores >= need
                if good.any():
                    got_id, got = _best(np.concatenate((got_id, xid[now][good])), np.concatenate((got, scores[good])), k)
                    if len(got) == k and got[-1] > need:
                        need = got[-1]
                left = left[bound[r, left] >= need]
            if len(got):
                for held, some in zip(out, (np.full(len(got), qid[r]), got_id, got), strict=True):
                    held.append(some)
        arrays = [pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out]
        return pa.Table.from_arrays(arrays, names=["query", "id", "score"])

    return run
