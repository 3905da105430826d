"""Suffix-array deduplication of exact byte strings across documents.

A string of ``length`` bytes that starts at two places is found by longest-factor arrays.
To bring the two places into one suffix array, every window of ``length`` bytes is assigned
to the smallest hash (the rightmost if tied) of the ``GRAM``-byte strings in it; equal
windows have equal anchors at equal offsets. Consecutive windows of one anchor form a
context, the bytes from the first window's start to the last one's end; there is about one
per 150 bytes, filed as a short row under its anchor's hash.

Anchors seen once are dropped. Contexts equal in full are counted, not compared: their
members repeat one another. Where an anchor has several distinct contexts, one copy of each
goes, with its bytes, to a task that builds the suffix array of a batch of anchor groups by
prefix doubling, its LCP array, and the previous and next smaller (greater) positions in
suffix order, hence the longest previous (next) factor of each position.

A group of more than GROUP contexts is dealt out before its arrays are built: by ranges of
suffixes (offsets before the anchor) and the bytes that all windows of a range share, which
equal windows have in common. Dealt groups of at most GROUP members get their arrays; those
whose members are all equal in the range are one repeat, as large as they are; what is larger
and unequal is dealt again in narrower ranges, down to single suffixes, which are equal. So
no task holds a hot anchor's contexts, and no size goes without arrays that needs them.

``keep="first"`` removes later copies (longest previous factor) and leaves the earliest in
the order of (key, position, text hash); ``keep="none"`` removes every copy.

Defined cases: null text is empty; texts shorter than ``length`` keep everything; texts of any
length are read whole, anchored in pieces that overlap by a window; a row repeated with its id
is a copy of itself for ``keep="none"``, and one place in the order for ``keep="first"``; null
ids come first; matches never cross documents; an empty table gives no rows; other columns
pass through whatever their names, but n_bytes, removed and kept_bytes are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import byte_texts, map_rows, spare_names, whole_text
from lanegraph.stage import discard, materialize

LENGTH = 400
#: Bytes of an anchor, a third of a window at most.
GRAM = 96
#: Contexts of a group whose arrays are built in one task; PARTS: ranges into which larger groups are dealt.
GROUP = 1024
PARTS = 4
#: Bytes of contexts after which a suffix array is built; it holds at most one group more.
BATCH = 300_000
#: Texts are anchored in pieces of this many bytes, which overlap by a window.
PIECE = 4_000_000

_BYTE = np.random.default_rng(11).integers(0, 2**63, 256).astype(np.uint64)
_BASE = np.uint64(0xD1342543DE82EF95)
_BACK = np.uint64(pow(0xD1342543DE82EF95, -1, 2**64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_LOW = np.uint64((1 << 23) - 1)


def _gram(length: int) -> int:
    return max(1, min(GRAM, length // 3))


class _Powers:
    """Powers of the hash base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 4096)
            self.up = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BASE))))
            self.down = np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, _BACK))))
        return self.up[:n], self.down[:n]


def anchors(text: bytes, length: int, powers: _Powers) -> Iterator[tuple[int, int, int, int]]:
    """(anchor hash, first window, last window, anchor position) of every context, in order."""
    for base in range(0, max(len(text) - length + 1, 0), PIECE):
        yield from ((h, s + base, e + base, a + base) for h, s, e, a in _anchors(text[base : base + PIECE + length - 1], length, powers))


def _anchors(text: bytes, length: int, powers: _Powers) -> Iterator[tuple[int, int, int, int]]:
    n, gram = len(text), _gram(length)
    up, down = powers.get(n)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[np.frombuffer(text, np.uint8)] * up)))
    h = (total[gram:] - total[:-gram]) * down[: n - gram + 1]
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h ^= h >> np.uint64(29)
    count, width = len(h), length - gram + 1
    key = (h & ~_LOW) | (_LOW - np.arange(count, dtype=np.uint64))
    blocks = -(-count // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:count] = key
    padded = padded.reshape(blocks, width)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(after[:windows], before[width - 1 : width - 1 + windows])
    place = (_LOW - (least & _LOW)).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    first, last = np.concatenate(([0], cut)), np.concatenate((cut, [windows])) - 1
    at = place[first]
    yield from zip(h[at].view(np.int64).tolist(), first.tolist(), last.tolist(), at.tolist(), strict=True)


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """id, tid (a hash of the text), text."""
    return docs.select(F.col(key).alias("id"), F.xxhash64(whole_text(text)).alias("tid"), F.col(text).alias("text"))


def _contexts(docs: DataFrame, length: int) -> DataFrame:
    """id, tid, anchor, body (hash of the context's bytes), start, stop (of the context), at (of the anchor)."""

    def run(batches):
        powers = _Powers()
        for b in batches:
            made = []
            for t in byte_texts(b, "text"):
                made.append([{"anchor": h, "body": _hash(t[s : e + length], a - s), "start": s, "stop": e + length, "at": a} for h, s, e, a in anchors(t, length, powers)] if len(t) >= length else [])
            yield {"c": made}

    rows = map_rows(docs, run, "c array<struct<anchor:bigint,body:bigint,start:bigint,stop:bigint,at:bigint>>", drop=("text",))
    return rows.select("id", "tid", F.inline("c"))


def _hash(data: bytes, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data, seed=seed) - (1 << 63)


def _ranked(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys and their dense ranks from 1. Keys of 43 bits with places of 20 are sorted as one number."""
    n = len(keys)
    if n < 1 << 20 and keys[keys.argmax()] < 1 << 43:
        both = np.sort((keys << np.uint64(20)) | np.arange(n, dtype=np.uint64))
        order, found = (both & np.uint64((1 << 20) - 1)).astype(np.int32), both >> np.uint64(20)
    else:
        order = np.argsort(keys).astype(np.int32)
        found = keys[order]
    rank = np.empty(n, np.int32)
    rank[order] = np.cumsum(np.concatenate(([1], found[1:] != found[:-1])))
    return order, rank


def suffix_array(data: np.ndarray, groups: np.ndarray, length: int) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Suffix order up to ``length`` bytes or more by prefix doubling; the ranks of each doubling; the first one's size.

    Suffixes end with their group (a number per place). The first size is the largest power of
    two that divides ``length``, 4 at most, so LCPs in steps of it decide about ``length``.
    """
    n = len(data)
    size = next(k for k in (4, 2, 1) if length % k == 0)
    packed, whole = np.zeros(n, np.uint64), np.ones(n, bool)
    for k in range(size):
        m = max(n - k, 0)
        inside = np.zeros(n, bool)
        inside[:m] = groups[k:] == groups[:m]
        ahead = np.zeros(n, np.uint64)
        ahead[:m] = data[k:]
        packed = (packed << np.uint64(8)) | np.where(inside, ahead, np.uint64(0))
        whole &= inside
    order, rank = _ranked((packed << np.uint64(1)) | whole)
    ranks, first = [rank], size
    while size < length and (n == 0 or rank[order[-1]] < n):
        ahead = np.zeros(n, np.uint64)
        if size < n:
            same = groups[size:] == groups[:-size]
            ahead[: n - size][same] = rank[size:][same]
        bits = np.uint64(max(n, 1).bit_length())
        order, rank = _ranked((rank.astype(np.uint64) << bits) | ahead)
        size *= 2
        ranks.append(rank)
    return order, ranks, first


def adjacent_lcp(order: np.ndarray, ranks: list[np.ndarray], first: int, groups: np.ndarray) -> np.ndarray:
    """LCP of each suffix with the one before it in the order (0 for the first), in steps of ``first``."""
    n = len(order)
    lcp = np.zeros(n, np.int64)
    bounds = np.append(np.flatnonzero(np.diff(groups)) + 1, n)
    ends = bounds[np.searchsorted(bounds, np.arange(n), side="right")]
    x, y = order[1:].astype(np.int64), order[:-1].astype(np.int64)
    end_x, end_y = ends[x], ends[y]
    for k in range(len(ranks) - 1, -1, -1):
        size = first << k
        ok = (x + size <= end_x) & (y + size <= end_y)
        ok[ok] = ranks[k][x[ok]] == ranks[k][y[ok]]
        lcp[1:][ok] += size
        x, y = x + ok * size, y + ok * size
    return lcp


def longest_factors(order: np.ndarray, lcp: np.ndarray, earlier: bool = True) -> np.ndarray:
    """Per position, the longest match with an earlier (or later) one: previous and next smaller
    (greater) positions in suffix order, found by pointer jumping, with the LCP minimum on the way."""
    n = len(order)
    order = order.astype(np.int64)
    value = order if earlier else n - 1 - order
    best = np.zeros(n, np.int64)
    for step in (-1, 1):
        v = value if step < 0 else value[::-1]
        gap = lcp if step < 0 else np.concatenate((lcp[1:], [0]))[::-1]
        to, low = np.arange(n) - 1, gap.copy()
        live = np.flatnonzero((to >= 0) & (v[np.maximum(to, 0)] > v))
        while len(live):
            old = to[live]
            low[live] = np.minimum(low[live], low[old])
            to[live] = to[old]
            live = live[(to[live] >= 0) & (v[np.maximum(to[live], 0)] > v[live])]
        low[to < 0] = 0
        best = np.maximum(best, low if step < 0 else low[::-1])
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _covered(starts: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Runs of bytes covered by windows at the (sorted) starts."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > length)
    return [(int(s), int(e) + length) for s, e in zip(starts[np.concatenate(([0], cut + 1))], starts[np.concatenate((cut, [len(starts) - 1]))], strict=True)]


def compare(bodies: list[bytes], length: int, keep: str) -> list[list[tuple[int, int]]]:
    """For contexts in their global order, the byte runs of each that repeat (earlier, or anywhere)."""
    data = np.frombuffer(b"".join(bodies), np.uint8)
    sizes = np.fromiter(map(len, bodies), np.int64, len(bodies))
    groups = np.repeat(np.arange(len(bodies)), sizes)
    order, ranks, step = suffix_array(data, groups, length)
    lcp = adjacent_lcp(order, ranks, step, groups)
    again = longest_factors(order, lcp) >= length
    if keep == "none":
        again |= longest_factors(order, lcp, earlier=False) >= length
    first = np.concatenate(([0], np.cumsum(sizes)))
    return [_covered(np.flatnonzero(again[first[k] : first[k + 1]]), length) for k in range(len(bodies))]


_SPANS = "anchor bigint, body bigint, spans array<struct<start:bigint,end:bigint>>"


def _compare_groups(members: DataFrame, length: int, keep: str) -> DataFrame:
    """_SPANS of members (grp, anchor, body, id, at, tid, shift, bytes), batched by group.

    ``bytes`` begin ``shift`` bytes into the context. A context comes once in a group, however
    often its row is repeated.
    """
    columns = ("grp", "anchor", "body", "id", "at", "tid", "shift", "bytes")

    def flush(rows):
        rows = sorted({r[:3]: r for r in rows}.values(), key=lambda r: r[3])
        found = compare([r[5] for r in rows], length, keep)
        rows = [(r, s) for r, s in zip(rows, found, strict=True) if s]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[1] for r, _ in rows], pa.int64()),
                pa.array([r[2] for r, _ in rows], pa.int64()),
                pa.array([[{"start": a + r[4], "end": e + r[4]} for a, e in s] for r, s in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
            ],
            names=["anchor", "body", "spans"],
        )

    def run(batches):
        rows, size, last = [], 0, None
        for b in batches:
            for grp, anchor, body, own, at, tid, shift, data in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in columns), strict=True):
                if size >= BATCH and grp != last:
                    yield flush(rows)
                    rows, size = [], 0
                last = grp
                rows.append((grp, anchor, body, (own is not None, own or 0, at, tid), shift, data))
                size += len(data)
        if rows:
            yield flush(rows)

    return members.select(*columns).repartition("grp").sortWithinPartitions("grp").mapInArrow(run, _SPANS)


def _deal(contexts: DataFrame, length: int, keep: str) -> DataFrame:
    """_SPANS of hot groups, dealt by ranges of windows and the bytes that a range's windows share."""
    a, last = F.col("a"), F.octet_length("bytes") - length
    node = contexts.select("anchor", "body", "id", "at", "tid", "bytes", (F.col("at") - F.col("start")).cast("int").alias("a"), F.lit(0).alias("lo"), F.lit(length - _gram(length)).alias("hi"))
    order, found = F.struct("id", "at", "tid"), None
    # Windows of a range begin low to top bytes before the anchor, as far as the context has them.
    mine = F.substring("bytes", a - F.col("top") + 1, F.col("top") - F.col("low") + length)
    core = F.substring("bytes", a - F.col("lo") + 1, length - F.col("hi") + F.col("lo"))
    keys = ["anchor", "lo", "hi", "core"]
    while True:
        ranged = node.withColumn("low", F.greatest("lo", a - last)).withColumn("top", F.least("hi", "a")).filter("low <= top")
        ranged = ranged.withColumn("core", F.xxhash64(core)).withColumn("own", F.xxhash64(mine, "low", "top"))
        sums = materialize(ranged.groupBy(*keys).agg(F.count("*").alias("n"), (F.min("own") == F.max("own")).alias("equal"), F.min(order).alias("first")).filter("n > 1"), "dealt-sums")
        both = ranged.join(sums, keys)
        again = F.lit(True) if keep == "none" else ~order.eqNullSafe(F.col("first"))
        span = F.struct((a - F.col("top")).cast("bigint").alias("start"), (a - F.col("low") + length).cast("bigint").alias("end"))
        whole = both.filter(F.col("equal") & again).select("anchor", "body", F.array(span).alias("spans"))
        few = both.filter(~F.col("equal") & (F.col("n") <= GROUP)).select(F.xxhash64(*keys).alias("grp"), "anchor", "body", "id", "at", "tid", (a - F.col("top")).alias("shift"), mine.alias("bytes"))
        spans = materialize(whole.union(_compare_groups(few, length, keep)), "dealt-found")
        found = spans if found is None else found.union(spans)
        step = F.ceil((F.col("hi") - F.col("lo") + 1) / PARTS).cast("int")
        parts = F.transform(F.sequence("lo", "hi", step), lambda p: F.struct(p.alias("lo"), F.least(p + step - 1, F.col("hi")).alias("hi")))
        rest = both.filter(~F.col("equal") & (F.col("n") > GROUP)).select("anchor", "body", "id", "at", "tid", "bytes", "a", F.inline(parts))
        node = materialize(rest, "dealt-next")
        if node.isEmpty():
            return found.groupBy("anchor", "body").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def repeated_spans(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "first") -> DataFrame:
    """id, tid, spans: byte runs to remove of each text that has any (not yet merged).

    Counts and other facts of a key are stage tables of their own before they are joined to
    the rows of the key, so that both sides of such a join are plain shuffles and adaptive
    execution can split a hot key.
    """
    own = _identified(docs, key, text)
    every = materialize(_contexts(own, length), "contexts")
    often = materialize(every.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor"), "anchors-repeated")
    seen = materialize(every.join(often, "anchor", "left_semi"), "contexts-repeated")
    discard(every, often)
    member = F.struct("id", "start", "tid", "stop", "at")
    distinct = materialize(seen.groupBy("anchor", "body").agg(F.count("*").alias("n"), F.min(member).alias("first")), "contexts-distinct")
    several = materialize(distinct.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1"), "anchors-several")
    wanted = distinct.join(several, "anchor").select("anchor", "body", "m", "first.*")
    per_text = materialize(wanted.groupBy("id", "tid").agg(F.collect_list(F.struct("anchor", "body", "m", "start", "stop", "at")).alias("w")), "contexts-wanted")
    bodies = materialize(_cut(own, per_text), "contexts-bytes")
    found = _compare_groups(bodies.filter(F.col("m") <= GROUP).withColumns({"grp": F.col("anchor"), "shift": F.lit(0)}), length, keep)
    hot = bodies.filter(F.col("m") > GROUP)
    if not hot.isEmpty():
        found = found.unionByName(_deal(hot, length, keep))
    found = materialize(found, "contexts-found")
    span = F.struct(F.col("start"), F.col("stop").alias("end"))
    first = F.struct("first.id", "first.start", "first.tid").alias("first")
    known = materialize(distinct.select("anchor", "body", "n", first).join(found, ["anchor", "body"], "left").filter("n > 1 or spans is not null"), "contexts-known")
    rows = seen.join(known, ["anchor", "body"])
    copied = F.col("n") > 1 if keep == "none" else ~F.struct("id", "start", "tid").eqNullSafe(F.col("first"))
    moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
    spans = rows.select("id", "tid", F.when(copied, F.array(span)).otherwise(moved).alias("spans")).filter("spans is not null")
    out = materialize(spans.groupBy("id", "tid").agg(F.flatten(F.collect_set("spans")).alias("spans")), "spans")
    discard(seen, distinct, several, per_text, bodies, found, known)
    return out


def _cut(own: DataFrame, per_text: DataFrame) -> DataFrame:
    """The wanted contexts with their bytes; a row repeated in a task gives them once."""
    wanted = per_text.toDF("id2", "tid2", "w")
    chosen = own.join(wanted, F.col("id").eqNullSafe(F.col("id2")) & (F.col("tid") == F.col("tid2"))).drop("id2", "tid2")

    def run(batches):
        done = set()
        for b in batches:
            made = []
            for key, tid, t, w in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("id", "tid")), byte_texts(b, "text"), b.column(b.schema.get_field_index("w")).to_pylist(), strict=True):
                made.append([x | {"bytes": t[x["start"] : x["stop"]]} for x in w] if (key, tid) not in done else [])
                done.add((key, tid))
            yield {"c": made}

    kind = "array<struct<anchor:bigint,body:bigint,m:bigint,start:bigint,at:bigint,bytes:binary>>"
    rows = map_rows(chosen, run, f"c {kind}", drop=("text", "w"))
    return rows.select("id", "tid", F.inline("c"))


def merge(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the union of spans."""
    out: list[list[int]] = []
    for s, e in sorted((x["start"], x["end"]) for x in spans or ()):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _whole_characters(text: bytes, s: int, e: int) -> tuple[int, int]:
    """The span without parts of UTF-8 characters at its ends."""
    while s < e and s < len(text) and text[s] & 0xC0 == 0x80:
        s += 1
    while e > s and e < len(text) and text[e] & 0xC0 == 0x80:
        e -= 1
    return s, e


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, keep: str = "first", whole_characters: bool = True) -> DataFrame:
    """``docs`` with n_bytes, removed (merged byte runs) and kept_bytes, the text without them."""
    own, tid, found = spare_names(docs.columns, "id", "tid", "spans")
    spans = repeated_spans(docs, key, text, length, keep).toDF(own, tid, found)
    placed = docs.join(spans, F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(whole_text(text)) == F.col(tid)), "left")

    def run(batches):
        for b in batches:
            made = {"n_bytes": [], "removed": [], "kept_bytes": []}
            for t, own in zip(byte_texts(b, text), b.column(b.schema.get_field_index(found)).to_pylist(), strict=True):
                runs = merge(own)
                if whole_characters:
                    runs = [(x, y) for x, y in (_whole_characters(t, x, y) for x, y in runs) if y > x]
                edges = [0, *(v for r in runs for v in r), len(t)]
                made["n_bytes"].append(len(t))
                made["removed"].append([{"start": x, "end": y} for x, y in runs])
                made["kept_bytes"].append(b"".join(t[edges[k] : edges[k + 1]] for k in range(0, len(edges), 2)))
            yield made

    return map_rows(placed, run, "n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept_bytes binary", drop=(own, tid, found))


def n_removed() -> Column:
    """Removed bytes of a deduplicate() row."""
    return F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
