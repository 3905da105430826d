"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

A window is ``size`` consecutive words of an item (a shorter item is one window). A document
that contains a window contains each of its shingles, so its rarest one is a necessary
prefix of length one. Shingles (five words, fewer in shorter windows) are ordered by how
often the whole corpus has them, every window is filed under its rarest, and documents probe
with their own shingles. A probe's position fixes the window's start (positional bound),
which must lie inside the document (length bound); the words are then compared one by one,
so hits are exact.

The benchmark is taken in blocks of at most ``block_words`` words: what is sent to the
executors is bounded by that, not by the benchmark. Documents are never shuffled; the corpus
counts are added per task and then per shingle. More blocks mean more narrow passes.

Defined cases: null or empty text, or one without words, has no words, no hits; texts of any
length are read whole; null or wordless items, and items with a null id, have no windows;
item ids may be of any type that sorts; an item repeated under several ids names them all;
of equally rare shingles the first in hash order is taken; repeated documents are judged
each; an empty benchmark hits nothing, an empty table gives no rows; other columns pass
through, but n_words, hit_spans and item_ids are replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import byte_texts, map_rows
from lanegraph.stage import materialize

#: A-Z lower-cased bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]``.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SHINGLE = 5


def words_of(text: bytes) -> list[bytes]:
    return WORD.findall(text.lower())


@dataclass
class Windows:
    """The distinct windows of one length, with the items of each, and their shingles."""

    length: int
    ids: np.ndarray  # windows x length, word numbers
    items: list[list[int]]
    shingles: np.ndarray  # sorted hashes of all shingles
    prefix: np.ndarray | None = None  # sorted hashes of the rarest shingles
    first: np.ndarray | None = None  # per prefix: where its windows begin in ``filed``
    filed: np.ndarray | None = None
    offset: np.ndarray | None = None  # per filed window: where its prefix lies in it


@dataclass
class Index:
    """One block of the benchmark."""

    vocabulary: dict[bytes, int]
    mix: np.ndarray  # a random number for each word, at 0 for unknown words
    windows: list[Windows] = field(default_factory=list)

    def numbers(self, text: bytes) -> np.ndarray:
        found = words_of(text)
        return np.fromiter(map(self.vocabulary.get, found, repeat(0)), np.int64, len(found))

    def hashes(self, ids: np.ndarray, length: int) -> np.ndarray:
        """A hash of the shingle at each position (last axis)."""
        s, n = min(SHINGLE, length), ids.shape[-1]
        if n < s:
            return np.zeros((*ids.shape[:-1], 0), np.uint64)
        mixed, out = self.mix[ids], np.zeros((*ids.shape[:-1], n - s + 1), np.uint64)
        for k in range(s):
            out = out * np.uint64(0x9E3779B97F4A7C15) + mixed[..., k : n - s + 1 + k]
        return out ^ (out >> np.uint64(31))


def build_index(items: list[tuple[int, bytes]], size: int) -> Index:
    vocabulary: dict[bytes, int] = {}
    by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
    for item, text in items:
        ids = [vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)]
        length = min(size, len(ids))
        for i in range(len(ids) - length + 1 if ids else 0):
            by_length.setdefault(length, {}).setdefault(tuple(ids[i : i + length]), set()).add(item)
    mix = np.random.default_rng(7).integers(1, 2**63, len(vocabulary) + 1).astype(np.uint64)
    index = Index(vocabulary, mix)
    for length, found in sorted(by_length.items()):
        ids = np.array(list(found), np.int64).reshape(-1, length)
        index.windows.append(Windows(length, ids, [sorted(x) for x in found.values()], np.unique(index.hashes(ids, length))))
    return index


def file_by_rarest(index: Index, counts: dict[tuple[int, int], int]) -> None:
    """Choose each window's rarest shingle; counts: (place in ``windows``, shingle) to corpus count."""
    for k, w in enumerate(index.windows):
        h = index.hashes(w.ids, w.length)
        place = np.searchsorted(w.shingles, h)
        often = np.array([counts.get((k, i), 0) for i in range(len(w.shingles))], np.int64)
        rank = np.empty(len(often), np.int64)
        rank[np.lexsort((np.arange(len(often)), often))] = np.arange(len(often))
        w.offset = np.argmin(rank[place], axis=1)
        chosen = h[np.arange(len(h)), w.offset]
        w.filed = np.argsort(chosen, kind="stable")
        w.offset = w.offset[w.filed]
        w.prefix, w.first = np.unique(chosen[w.filed], return_index=True)
        w.first = np.append(w.first, len(h))


def _at(sorted_values: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``values`` whose value is among the sorted, and its place there."""
    place = np.searchsorted(sorted_values, values)
    place[place == len(sorted_values)] = 0
    at = np.flatnonzero(sorted_values[place] == values) if len(sorted_values) else np.zeros(0, np.int64)
    return at, place[at]


def probe(index: Index, ids: np.ndarray) -> tuple[np.ndarray, set[int]]:
    """Which words are hit, and the items with windows in the document."""
    hit, items = np.zeros(len(ids) + 1, np.int64), set()
    for w in index.windows:
        if len(ids) < w.length:
            continue
        at, place = _at(w.prefix, index.hashes(ids, w.length))
        many = w.first[place + 1] - w.first[place]
        rows = np.repeat(w.first[place], many) + (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
        start = np.repeat(at, many) - w.offset[rows]
        inside = (start >= 0) & (start + w.length <= len(ids))
        start, rows = start[inside], w.filed[rows[inside]]
        same = (ids[start[:, None] + np.arange(w.length)] == w.ids[rows]).all(axis=1)
        np.add.at(hit, start[same], 1)
        np.add.at(hit, start[same] + w.length, -1)
        for r in np.unique(rows[same]):
            items.update(w.items[r])
    return np.cumsum(hit)[:-1] > 0, items


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, bytes]]]:
    block, n = [], 0
    for row in benchmark.filter("item_id is not null and text is not null").select("item_id", F.encode("text", "UTF-8").alias("text")).toLocalIterator():
        block.append((row["item_id"], bytes(row["text"])))
        n += len(block[-1][1]) // 2 + 1
        if n >= block_words:
            yield block
            block, n = [], 0
    if block:
        yield block


def _count(docs: DataFrame, index, text: str) -> dict[tuple[int, int], int]:
    """Corpus count of every shingle of the block; as many rows at most as it has shingles."""

    def run(batches):
        own = index.value
        sums = [np.zeros(len(w.shingles), np.int64) for w in own.windows]
        for b in batches:
            for t in byte_texts(b, text):
                ids = own.numbers(t)
                for w, s in zip(own.windows, sums, strict=True):
                    _, place = _at(w.shingles, own.hashes(ids, w.length))
                    np.add.at(s, place, 1)
        for k, s in enumerate(sums):
            at = np.flatnonzero(s)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k)), pa.array(at), pa.array(s[at])], names=["k", "i", "n"])

    rows = docs.select(text).mapInArrow(run, "k long, i long, n long").groupBy("k", "i").agg(F.sum("n").alias("n"))
    return {(r["k"], r["i"]): r["n"] for r in rows.toLocalIterator()}


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", block_words: int = 1_000_000) -> DataFrame:
    """``docs`` with n_words, hit_spans (word positions, end exclusive) and item_ids (sorted)."""
    sc = docs.sparkSession.sparkContext
    out, fields = docs, f"n_words long, hit_spans array<struct<start:int,end:int>>, item_ids array<{benchmark.schema['item_id'].dataType.simpleString()}>"
    blocks = _blocks(benchmark, block_words)
    block, earlier = next(blocks, []), None
    while block is not None:
        index = build_index(block, size)
        counted = sc.broadcast(index)
        file_by_rarest(index, _count(docs, counted, text))
        counted.destroy()
        sent, more = sc.broadcast(index), earlier is not None

        def run(batches, sent=sent, more=more):
            own = sent.value
            for b in batches:
                made = {"n_words": [], "hit_spans": [], "item_ids": []}
                old = [b.column(b.schema.get_field_index(c)).to_pylist() for c in ("hit_spans", "item_ids")] if more else None
                for k, t in enumerate(byte_texts(b, text)):
                    ids = own.numbers(t)
                    hit, items = probe(own, ids)
                    if more:
                        for span in old[0][k]:
                            hit[span["start"] : span["end"]] = True
                        items |= set(old[1][k])
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], hit.astype(np.int8), [0]))))
                    made["n_words"].append(len(ids))
                    made["hit_spans"].append([{"start": int(s), "end": int(e)} for s, e in zip(edge[::2], edge[1::2], strict=True)])
                    made["item_ids"].append(sorted(items))
                yield made

        out = map_rows(out, run, fields)
        block = next(blocks, None)
        if block is not None:
            out = materialize(out, "decontaminate")
        earlier = out
    return out


def n_hit() -> Column:
    """Hit words of a decontaminate() row."""
    return F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])


def digest() -> Column:
    """SHA-256 of the item ids, sorted as strings and joined by commas."""
    return F.sha2(F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ","), 256)
