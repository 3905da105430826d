"""Phrase collocations: the cut of a phrase that binds it least, over exact counts of a whole corpus.

Texts are cut into pieces; equal pieces of a language become one row with a multiplicity, so
what is repeated is read once. Weighted n-grams are counted in two steps by the same DuckDB sum,
which spills to its task's own scratch folder beyond MEMORY: over the pieces of a map task, and
then over a hash bucket of phrases. A map task sorts its sums by bucket and ships them as
compressed parts of up to PART rows, which are a fraction of the rows' size. What is below ``least`` is dropped only there, where counts
are whole. A phrase is never more frequent than what it is made of, so there are three passes:
words; sums by hash of the pairs whose words are frequent (of two pairs with one hash the sum
is too high, never too low); and all phrases of several words whose pairs may be frequent,
by their bytes. What may be skipped is known from a bitmap of 2**BITS bits (8 MB, at every size)
over hashes of the frequent words or pairs; sharing a bit costs needless counting, never a count.

The counts of a phrase's parts lie in other buckets: each cut sends a request to either part's
bucket, and the answers meet at the phrase. No list of words or phrases is collected.

Arithmetic is in decimals of 38 digits, exact while 1000 * a * n stays below 10**38.

Defined cases: null text is empty; a null language is ``und``; words are what blanks and tabs
separate, bytes are compared; texts and pieces of any length are read whole; rows repeated with
their id count again; an empty table gives no rows; other columns take no part.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanegraph.llm.common import ascii_lower, whole_text
from lanegraph.stage import discard, materialize

LONGEST, LEAST, FIRST = 5, 100, 2000
#: Bits of the bitmap, as a power of two, and memory of a task's sums before they spill.
BITS, MEMORY = 26, "256MB"
#: Rows of a shipped part at most, and hash buckets for each shuffle partition.
PART, BUCKETS = 100_000, 4

_GRAMS = pa.schema([("lang", pa.binary()), ("phrase", pa.binary()), ("f", pa.int64())])
_SUMS = pa.schema([("h", pa.int64()), ("f", pa.int64())])


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, piece (words with one blank between), m: how often the language has that piece."""
    plain = F.btrim(F.regexp_replace(ascii_lower(whole_text(text)), r"[\x20\x09]+", " "), F.lit(" "))
    parts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.explode(F.split(plain, r" ?[.,;:!?\x0A-\x0D] ?")).alias("piece"))
    # blanks between two marks belong to the first, so the second may leave one
    parts = parts.select("lang", F.btrim("piece", F.lit(" ")).alias("piece")).filter("piece <> ''")
    return parts.groupBy("lang", "piece").agg(F.count("*").alias("m"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", longest: int = LONGEST, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """The ``first`` phrases (of 2 to ``longest`` words) of each language: lang, rank, phrase, a, l, r, n, score."""
    once = materialize(pieces(docs, text, lang), "phrase-pieces")
    total = once.groupBy("lang").agg(F.sum(F.size(F.split("piece", " ")) * F.col("m")).alias("n"))
    words = _counted(once, (1,), least, None)
    pairs = _pair_sums(once, least, _bitmap(words.select(F.xxhash64(F.col("lang").cast("string"), F.col("phrase").cast("string")).alias("h"))))
    more = _counted(once, tuple(range(2, max(longest, 2) + 1)), least, _bitmap(pairs))
    counts = materialize(words.unionByName(more).select(F.col("lang").cast("string").alias("lang"), F.col("phrase").cast("string").alias("phrase"), "f"), "phrase-counts")
    discard(words, pairs, more)
    found = best_cuts(counts, total)
    kept = found.join(absorbed(counts), ["lang", "phrase"], "left").filter(F.col("inside").isNull() | (F.col("inside") < F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= first)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def best_cuts(counts: DataFrame, total: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, n, score of every phrase of several words, at its lowest cut (the first of equals).

    Two requests go out per cut, one to each part, and are answered where the part's count is.
    """
    words = F.split("phrase", " ")
    cuts = counts.withColumn("words", words).filter(F.size("words") > 1).select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    side = lambda name, part: F.struct(F.lit(name).alias("side"), F.array_join(part, " ").alias("part"))
    rest = F.slice("words", F.col("k") + 1, F.size("words") - F.col("k"))
    asked = cuts.select("lang", "phrase", "a", "k", F.inline(F.array(side("l", F.slice("words", F.lit(1), F.col("k"))), side("r", rest))))
    told = asked.join(counts.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
    of = lambda name: F.max(F.when(F.col("side") == name, F.col("f"))).alias(name)
    sides = told.groupBy("lang", "phrase", "k").agg(F.first("a").alias("a"), of("l"), of("r")).join(total, "lang")
    exact = lambda c: F.col(c).cast("decimal(19,0)")
    over, under = (F.lit(1000).cast("decimal(4,0)") * exact("a") * exact("n")).cast("decimal(38,0)"), (exact("l") * exact("r")).cast("decimal(38,0)")
    scored = sides.withColumn("over", over).withColumn("under", under).withColumn("score", F.expr("over div under"))
    cut = F.struct("score", "k", "a", "l", "r", "n")
    return scored.groupBy("lang", "phrase").agg(F.min(cut).alias("cut")).select("lang", "phrase", "cut.a", "cut.l", "cut.r", "cut.n", "cut.score")


def absorbed(counts: DataFrame) -> DataFrame:
    """lang, phrase, inside: of phrases that lie in a longer one, the count of the most frequent such."""
    words = F.split("phrase", " ")
    long = counts.select("lang", "f", words.alias("words")).filter(F.size("words") > 2)
    starts = long.select("lang", "f", "words", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("i"))
    ends = starts.select("*", F.explode(F.sequence(F.lit(2), F.size("words") - F.col("i") + 1)).alias("k")).filter(F.col("k") < F.size("words"))
    return ends.select("lang", F.array_join(F.slice("words", F.col("i"), F.col("k")), " ").alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("inside"))


def _rows(once: DataFrame, shortest: int, hashes: bool) -> DataFrame:
    """Pieces of so many words at least, as bytes, with hashes ``h`` of their words and language where asked for."""
    words = F.split("piece", " ")
    h = [F.transform(words, lambda w: F.xxhash64("lang", w)).alias("h")] if hashes else []
    return once.filter(F.size(words) >= shortest).select(F.col("lang").cast("binary").alias("lang"), "piece", "m", *h)


def _counted(once: DataFrame, lengths: tuple[int, ...], least: int, admitted: Broadcast | None) -> DataFrame:
    """lang, phrase, f of the phrases of these lengths that occur ``least`` times; a stage table. ``admitted``: pairs."""
    return _summed(_rows(once, min(lengths), admitted is not None), lambda batches: _grams(batches, lengths, admitted), _GRAMS, "lang binary, phrase binary, f bigint", least)


def _pair_sums(once: DataFrame, least: int, admitted: Broadcast) -> DataFrame:
    """h, f: sums by hash of the pairs of admitted words; a stage table."""
    return _summed(_rows(once, 2, True), lambda batches: _pairs(batches, admitted), _SUMS, "h bigint, f bigint", least)


def _summed(rows: DataFrame, make: Callable, schema: pa.Schema, fields: str, least: int) -> DataFrame:
    """``f`` of what ``make`` yields added up by all other columns, from ``least`` on: first by map task, then by bucket."""
    buckets = BUCKETS * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = rows.mapInArrow(lambda batches: _parted(make(batches), schema, buckets), "bucket int, part binary")

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shipped = (b for batch in batches for part in batch.column(1) for b in pa.ipc.open_stream(part.as_buffer()))
        with _sums(shipped, schema, f"HAVING sum(f) >= {least}") as found:
            yield from found

    return materialize(parts.repartition("bucket").mapInArrow(whole, fields), "phrase-sums")


@contextmanager
def _sums(batches: Iterable[pa.RecordBatch], schema: pa.Schema, rest: str, buckets: int = 0) -> Iterator[pa.RecordBatchReader]:
    """Sums out of core; what the task has in its scratch folder goes with it."""
    by = ", ".join(n for n in schema.names if n != "f")
    bucket = f"(hash({by}) % {buckets})::INT AS bucket, " if buckets else ""
    with tempfile.TemporaryDirectory() as scratch:
        config = {"threads": 1, "memory_limit": MEMORY, "temp_directory": scratch, "preserve_insertion_order": False, "autoinstall_known_extensions": False}
        with duckdb.connect(config=config) as db:
            db.register("grams", pa.RecordBatchReader.from_batches(schema, (b.cast(schema) for b in batches)))
            yield db.sql(f"SELECT {bucket}{by}, sum(f)::BIGINT AS f FROM grams GROUP BY {by} {rest}").to_arrow_reader(PART)


def _parted(batches: Iterator[pa.RecordBatch], schema: pa.Schema, buckets: int) -> Iterator[pa.RecordBatch]:
    """A map task's sums as parts (bucket, compressed rows), sorted."""
    options = pa.ipc.IpcWriteOptions(compression="zstd")
    with _sums(batches, schema, "ORDER BY ALL", buckets) as found:
        for b in found:
            bucket, own = b.column(0).to_numpy(), b.select(schema.names)
            edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(b)]
            for start, end in zip(edges, edges[1:], strict=False):
                if end > start:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, schema, options=options) as out:
                        out.write_batch(own.slice(start, end - start).cast(schema))
                    yield pa.RecordBatch.from_arrays([pa.array([bucket[start]], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["bucket", "part"])


def _bitmap(hashes: DataFrame) -> Broadcast:
    """Bits of the hashes (h); at most 2**(BITS - 6) rows of 64 bits come to the driver."""
    at = hashes.select(F.shiftrightunsigned("h", 64 - BITS).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 AS int))")).alias("bits"))
    out = np.zeros(1 << max(BITS - 6, 0), np.int64)
    for row in words.toLocalIterator():
        out[row.word] = row.bits
    return hashes.sparkSession.sparkContext.broadcast(out.view(np.uint8))


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes, in order."""
    x = a * np.uint64(0x9E3779B97F4A7C15) ^ (b + (a >> np.uint64(29)))
    return (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def _has(admitted: Broadcast, hashes: np.ndarray) -> np.ndarray:
    bits = admitted.value
    at = (hashes >> np.uint64(65 - (8 * len(bits)).bit_length())).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def _word_hashes(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of a batch's words, the row of each, and the words from it to its piece's end."""
    lists = b.column(b.schema.get_field_index("h"))
    sizes = lists.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(b)), sizes)
    return lists.flatten().to_numpy().view(np.uint64), row, np.cumsum(sizes)[row] - np.arange(len(row))


def _pairs(batches: Iterator[pa.RecordBatch], admitted: Broadcast) -> Iterator[pa.RecordBatch]:
    """Hashes of the pairs of admitted words with their piece's multiplicity."""
    for b in batches:
        h, row, left = _word_hashes(b)
        good = _has(admitted, h)
        at = np.flatnonzero(good[:-1] & good[1:] & (left[:-1] > 1))
        yield pa.RecordBatch.from_arrays([pa.array(_joined(h[at], h[at + 1]).view(np.int64)), b.column(b.schema.get_field_index("m")).take(pa.array(row[at]))], schema=_SUMS)


def _grams(batches: Iterator[pa.RecordBatch], lengths: tuple[int, ...], admitted: Broadcast | None) -> Iterator[pa.RecordBatch]:
    """Phrases of these lengths, all of whose pairs are admitted, with their piece's multiplicity."""
    for b in batches:
        words = pc.split_pattern(b.column(b.schema.get_field_index("piece")), " ").flatten().cast(pa.binary())
        if admitted is None:
            row = np.repeat(np.arange(len(b)), pc.add(pc.count_substring(b.column(b.schema.get_field_index("piece")), " "), 1).to_numpy())
            run, left, pair = np.ones(len(row), bool), np.ones(len(row)), np.ones(len(row), bool)
        else:
            h, row, left = _word_hashes(b)
            pair = np.zeros(len(row), bool)
            pair[:-1] = _has(admitted, _joined(h[:-1], h[1:]))
            run = np.ones(len(row), bool)
        for k in range(1, max(lengths) + 1):
            if k > 1:
                run[: len(run) - k + 2] &= pair[k - 2 :]  # the pair of the words k - 1 and k from here
            if k not in lengths:
                continue
            at = np.flatnonzero(run & (left >= k))
            if len(at):
                own = [words.take(pa.array(at + j)) for j in range(k)]
                phrase = pc.binary_join_element_wise(*own, pa.scalar(b" ")) if k > 1 else own[0]
                owner = pa.array(row[at])
                yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("lang")).take(owner), phrase, b.column(b.schema.get_field_index("m")).take(owner)], schema=_GRAMS)
