"""MinHash near-deduplication by a multi-index Hamming join.

Signature. A document's set is its distinct shingles of five words; its signature holds
b-bit minimum hashes. The first chunks x WIDTH of them, 16 bits each, are split into chunks.
Two signatures that differ in at most ``bound`` = chunks * (ERRORS + 1) - 1 of these places
have, by pigeonhole, a chunk with at most ERRORS differing places; each chunk is filed once
for every choice of ERRORS places left out, so every pair within the bound shares a key, and
every such pair is confirmed on full sets. Pairs beyond the bound that share a key all the
same are confirmed too unless they differ in more than ``far`` of all places. The number of
chunks, ``far`` and the bound on set sizes follow from ``percent`` (see Scheme): a pair at
exactly that similarity is missed with a probability of about 1e-5, more alike ones less.

Join. Documents with equal sets are one node, and one text of each goes on. Keys are
filed as (key, node) rows. First every bucket links its members to its smallest member (as many
pairs as rows); these pairs are checked on full sets, and the confirmed links give components.
Only buckets that still hold several components go on: small ones give their pairs across
components as rows; larger ones are dealt in pairs of blocks of BLOCK_BYTES of sets, and tasks
confirm the pairs across components within the signature distance on the spot, so what they
emit is one link per merge of components, not pairs. No bucket, block or partner is capped.
Every link is confirmed on full shingle sets.

Defined cases: null, empty or wordless text has an empty set, links with nothing and is its
own component; fewer than five words are one shingle; texts of any length are read whole;
rows of one id are one document: they share a component, which holds what is like any of their
texts, and are all judged alike; rows with a null id are
left unlinked, with a null component, and kept; ids are whole numbers; an empty table gives
no rows; near_duplicates() returns its own columns alone, keep_firsts() those of ``docs``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import byte_texts, map_rows, whole_text
from lanegraph.operators.components import connected_components
from lanegraph.stage import discard, materialize

SHINGLE = 5
WIDTH, ERRORS = 4, 1
#: Places of the longest signature, and of the shortest.
MOST, LEAST = 400, 128
#: Buckets up to this size give their pairs as rows; larger ones are compared in blocks.
SMALL = 32
#: Bytes of sets (8 a shingle) that a block holds on average; its rows are dealt by a hash.
BLOCK_BYTES = 16_000_000


@dataclass(frozen=True)
class Scheme:
    """Signature and thresholds for a similarity of ``percent`` or more."""

    percent: int
    chunks: int
    size: int
    far: int

    @property
    def bound(self) -> int:
        """Differing places, of the first chunks x WIDTH, up to which a shared key is certain."""
        return self.chunks * (ERRORS + 1) - 1

    def near(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether signatures are within the bound, or not too far in all places."""
        apart = x != y
        return (apart.sum(axis=-1) <= self.far) | (apart[..., : self.chunks * WIDTH].sum(axis=-1) <= self.bound)


@cache
def scheme(percent: int) -> Scheme:
    """Fewest chunks that miss a pair at the similarity with at most 1e-5; ``far`` is 4.5 deviations from its mean distance."""
    p = percent / 100
    one = p**WIDTH + WIDTH * p ** (WIDTH - 1) * (1 - p)
    chunks = MOST // WIDTH
    if one >= 1:
        chunks = 1
    elif one > 0:
        chunks = min(chunks, int(np.ceil(np.log(1e-5) / np.log1p(-one))))
    if not 0 < percent <= 100 or (1 - one) ** chunks > 1.1e-5:
        raise ValueError(f"no signature of {MOST} places finds pairs at {percent} %")
    size = max(LEAST, chunks * WIDTH)
    return Scheme(percent, chunks, size, int(size * (1 - p) + 4.5 * np.sqrt(size * p * (1 - p))))


#: Ids up to this many are broadcast to filter the texts whose sets are needed.
SENT_IDS = 1_000_000

_rng = np.random.default_rng(20240501)
_FACTOR = _rng.integers(1, 2**63, MOST).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_TERM = _rng.integers(0, 2**63, MOST).astype(np.uint64)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_LEFT = [c for c in combinations(range(WIDTH), WIDTH - ERRORS)]


class _Words(dict):
    """word -> 64-bit hash, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, words: _Words) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles (A-Z lower-cased)."""
    found = text.lower().split()
    n = len(found)
    if not n:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, found), np.uint64, n)
    size = min(SHINGLE, n)
    h = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        h = (h ^ w[k : n - size + 1 + k]) * _STEP
        h ^= h >> np.uint64(29)
    return np.unique(h)


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """``size`` minimum hashes, 16 bits each."""
    low = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 1024):
        low = np.minimum(low, (shingles[k : k + 1024, None] * _FACTOR[:size] + _TERM[:size]).min(axis=0))
    low = (low ^ (low >> np.uint64(31))) * _STEP
    return (low >> np.uint64(48)).astype(np.uint16)


def keys_of(sig: np.ndarray, count: int) -> list[int]:
    """One key for each of ``count`` chunks and every choice of places left out."""
    chunks = sig[: count * WIDTH].astype(np.int64).reshape(count, WIDTH)
    out = []
    for j, left in enumerate(_LEFT):
        key = np.arange(count, dtype=np.int64) * len(_LEFT) + j
        for k in left:
            key = (key << 16) | chunks[:, k]
        out += key.tolist()
    return out


def _texts(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, tid, text: a place is an id with a text."""
    return docs.select(F.col(key).alias("id"), F.xxhash64(whole_text(text)).alias("tid"), F.col(text).alias("text"))


def signatures(docs: DataFrame, key: str, text: str, plan: Scheme) -> DataFrame:
    """id, tid (text hash), n_shingles, set_id (a 128-bit hash of the set), sig, keys."""

    def run(batches):
        words = _Words()
        for b in batches:
            made = {"n_shingles": [], "set_id": [], "sig": [], "keys": []}
            for t in byte_texts(b, "text"):
                s = shingle_set(t, words)
                sig = signature(s, plan.size)
                made["n_shingles"].append(len(s))
                made["set_id"].append(xxhash.xxh3_128_digest(s.tobytes()))
                made["sig"].append((sig & np.uint16(255)).astype(np.uint8).tobytes())
                made["keys"].append(keys_of(sig, plan.chunks) if len(s) else [])
            yield made

    return map_rows(_texts(docs, key, text), run, "n_shingles long, set_id binary, sig binary, keys array<bigint>", drop=("text",))


def _near(pairs: DataFrame, sigs: DataFrame, plan: Scheme) -> DataFrame:
    """Of pairs (a, b), those near by signature and by the bound on set sizes."""
    one = sigs.select(F.col("node").alias("a"), F.col("n_shingles").alias("na"), F.col("sig").alias("sa"))
    two = sigs.select(F.col("node").alias("b"), F.col("n_shingles").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").filter(100 * F.least("na", "nb") >= plan.percent * F.greatest("na", "nb"))

    def run(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(b.schema.get_field_index(c)).to_pylist()), np.uint8).reshape(-1, plan.size) for c in ("sa", "sb"))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(c)) for c in ("a", "b", "na", "nb")], names=["a", "b", "na", "nb"]).filter(pa.array(plan.near(x, y)))

    return both.select("a", "b", "na", "nb", "sa", "sb").mapInArrow(run, "a bigint, b bigint, na bigint, nb bigint")


def _confirm(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (src, dst): 100 * intersection >= percent * union on full sets."""
    x = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y")).cast("long")
    return (
        near.join(x, "a")
        .join(y, "b")
        .select("a", "b", "na", "nb", common.alias("common"))
        .filter(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common")))
        .select(F.col("a").alias("src"), F.col("b").alias("dst"))
    )


def _sets(docs: DataFrame, needed: DataFrame, key: str, text: str) -> DataFrame:
    """node, shingles of the places needed (node, id, tid)."""
    own = _texts(docs, key, text).filter("id is not null")
    chosen = own.join(F.broadcast(needed) if needed.count() <= SENT_IDS else needed, ["id", "tid"]).select("node", "text")

    def run(batches):
        words = _Words()
        for b in batches:
            yield {"shingles": [shingle_set(t, words).view(np.int64) for t in byte_texts(b, "text")]}

    return materialize(map_rows(chosen, run, "shingles array<bigint>", drop=("text",)), "near-sets")


def _links(batch, plan: Scheme) -> list[tuple[int, int]]:
    """Confirmed links across components of a block pair's rows, one for each merge of two components."""
    one, two = batch[batch.side != 1], batch[batch.side != 0]
    same = len(batch) and batch.side.iloc[0] == 2
    x, y = (np.frombuffer(b"".join(t.sig), np.uint8).reshape(-1, plan.size) for t in (one, two))
    n, m, ids = one.n_shingles.to_numpy(), two.n_shingles.to_numpy(), two.node.to_numpy()
    sets, others = ([np.asarray(v, np.int64).view(np.uint64) for v in t.shingles] for t in (one, two))
    codes = np.unique(batch.component.to_numpy(), return_inverse=True)[1]
    top, c, e = np.arange(codes.max(initial=0) + 1), codes[(batch.side != 1).to_numpy()], codes[(batch.side != 0).to_numpy()]
    out = []
    for k in range(len(one)):
        at = np.flatnonzero((top[e] != top[c[k]]) & (100 * np.minimum(m, n[k]) >= plan.percent * np.maximum(m, n[k])))
        at = at[at > k] if same else at
        at = at[plan.near(y[at], x[k])]
        for part in np.array_split(at, -(-len(at) // 256) or 1):
            if not len(part):
                continue
            values = np.concatenate([others[o] for o in part])
            place = np.searchsorted(sets[k], values)
            place[place == len(sets[k])] = 0
            common = np.add.reduceat((sets[k][place] == values).astype(np.int64), np.concatenate(([0], np.cumsum(m[part])[:-1])))
            for o in part[100 * common >= plan.percent * (n[k] + m[part] - common)]:
                if top[c[k]] != top[e[o]]:
                    top[top == top[e[o]]] = top[c[k]]
                    out.append((one.node.iloc[k], ids[o]))
    return out


def _rest(buckets: DataFrame, sigs: DataFrame, sets: DataFrame, components: DataFrame, plan: Scheme) -> DataFrame:
    """Links across components of the buckets (key, node, n) that hold several."""
    placed = materialize(buckets.join(components, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-placed")
    mixed = materialize(placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"), "near-mixed")
    open_ = materialize(placed.join(mixed, "key", "left_semi"), "near-open")
    discard(placed, mixed)
    groups = open_.filter(F.col("n") <= SMALL).groupBy("key").agg(F.collect_set(F.struct("node", "component")).alias("m"))
    pair = lambda x: F.transform(F.filter("m", lambda y: (y["node"] > x["node"]) & (y["component"] != x["component"])), lambda y: F.struct(x["node"].alias("a"), y["node"].alias("b")))
    few = groups.select(F.inline(F.flatten(F.transform("m", pair))))
    hot = open_.filter(F.col("n") > SMALL)
    links = _confirm(_near(few.distinct(), sigs, plan), sets, plan.percent)
    if hot.isEmpty():
        return links
    known = materialize(hot.join(sigs.select("node", "n_shingles", "sig"), "node"), "near-hot")
    blocks = materialize(known.groupBy("key").agg(F.ceil(8 * F.sum("n_shingles") / BLOCK_BYTES).cast("int").alias("blocks")), "near-blocks")
    spread = (
        known.join(blocks, "key")
        .withColumn("mine", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .withColumn("i", F.least("mine", "other"))
        .withColumn("j", F.greatest("mine", "other"))
        .withColumn("side", F.when(F.col("i") == F.col("j"), 2).when(F.col("mine") == F.col("i"), 0).otherwise(1))
        .select("key", "i", "j", "side", "node", "component", "n_shingles", "sig")
        .join(sets, "node")
    )

    def run(batch):
        import pandas as pd

        return pd.DataFrame(_links(batch, plan), columns=["src", "dst"])

    return links.union(spread.groupBy("key", "i", "j").applyInPandas(run, "src bigint, dst bigint")).distinct()


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """id, n_shingles, component_id, kept: one row per row of ``docs``."""
    plan = scheme(percent)
    sigs = materialize(signatures(docs, key, text, plan), "near-signatures")
    filled = sigs.filter("n_shingles > 0 and id is not null")
    # Equal sets are one node, numbered for the joins, with the first place that has it.
    classes = filled.groupBy("set_id").agg(F.min(F.struct("id", "tid")).alias("rep")).select("set_id", "rep.*", F.monotonically_increasing_id().alias("node"))
    classes = materialize(classes, "near-classes")
    firsts = filled.join(classes, ["set_id", "id", "tid"]).dropDuplicates(["set_id"])
    firsts = materialize(firsts.select("node", "id", "tid", "n_shingles", "sig", "keys"), "near-firsts")
    filed = firsts.select(F.explode("keys").alias("key"), "node")
    # A stage table of its own, so that the join with it is of two plain shuffles and a hot key can be split.
    shared = materialize(filed.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("hub")).filter("n > 1"), "near-shared")
    buckets = materialize(filed.join(shared, "key"), "near-buckets")
    needed = buckets.select("node").distinct()
    lone = materialize(firsts.select("node", "id", "tid", "n_shingles", "sig").join(needed, "node", "left_semi"), "near-lone")
    discard(shared, firsts)
    sets = _sets(docs, lone.select("node", "id", "tid"), key, text).dropDuplicates(["node"])
    stars = buckets.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct()
    links = materialize(_confirm(_near(stars, lone, plan), sets, percent), "near-links")
    components = connected_components(links)
    more = materialize(_rest(buckets.select("key", "node", "n"), lone, sets, components, plan), "near-links")
    # Rows of one id are one document, so an id with several texts joins their nodes.
    of = materialize(filled.select("id", "set_id").distinct().join(classes.select("set_id", "node"), "set_id").select("id", "node"), "near-of")
    lowest = materialize(of.groupBy("id").agg(F.min("node").alias("src"), F.max("node").alias("last")).filter("src < last").select("id", "src"), "near-several")
    same = of.join(lowest, "id").filter("node <> src").select("src", F.col("node").alias("dst"))
    final = connected_components(links.union(more).union(same))
    placed = materialize(of.join(final, "node", "left").select("id", F.coalesce("component", "node").alias("grp")), "near-placed")
    least = materialize(placed.groupBy("grp").agg(F.min("id").alias("component")), "near-least")
    owned = materialize(placed.join(least, "grp").select("id", "component").distinct(), "near-owned")
    out = sigs.select("id", "n_shingles").join(owned, "id", "left")
    discard(buckets, lone, classes, links, more, components, of, lowest, placed, least)
    component = F.coalesce("component", "id")
    return out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def keep_firsts(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75) -> DataFrame:
    """``docs`` without the rows whose component has a smaller id."""
    gone = near_duplicates(docs, key, text, percent).filter("not kept").select(F.col("id").alias(key)).distinct()
    return docs.join(gone, key, "left_anti")
