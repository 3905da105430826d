"""Best-fit packing of tokenized documents by bin completion.

Documents become token pieces of at most ``capacity`` ids (only longer documents are cut; the
first piece takes the remainder). Which pieces share a sequence depends on lengths alone, so
the search runs on the histogram of lengths: at most ``capacity`` rows reach the driver,
whatever the corpus. Bin completion takes the largest remaining length, enumerates all
undominated fillings of the room beside it, fullest and with the largest pieces first (the
best fit, which gives the incumbent), repeats a filling as often as the counts allow (on
backtracking less often), and prunes branches whose bins so far plus the waste bound (tokens
left / capacity) cannot beat the incumbent. It stops at the lower bound or after ``nodes``
branches, so the result is never worse than the first, best-fit descent.

Pieces then get their rank within their length and each rank falls into one filling's slot.
Ranks are counted per (length, bucket), so one length may hold any share of the pieces; the
slots (at most capacity x 64 rows) are broadcast.

Defined cases: null or empty text is the end id alone, one piece of length 1; texts of any
length are encoded whole; repeated rows are packed each; pieces of equal length are placed in
the order of a hash of their keys, then of the keys; an empty table gives no pieces; columns
other than the text pass through whatever their names, but piece, start, length, ids,
ids_crc32, sequence_id and offset are replaced.
"""

from __future__ import annotations

import json
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lanegraph.llm.common import map_rows, spare_names
from lanegraph.stage import materialize

CAPACITY = 2048
END_ID = 0


def vocabulary_path() -> str:
    """The default vocabulary, of the installed public tokenizer files."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def encoder(path: str):
    """text -> ids, as the byte-level BPE tokenizer at ``path`` gives without added special tokens.

    Where the merges are ranked like their ids, the quicker encoder of the same vocabulary is
    used (tests hold it against the tokenizers library); else that library itself.
    """
    spec = json.loads(open(path, encoding="utf-8").read())
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ids = [vocab[a + b] for a, b in pairs]
    if spec["pre_tokenizer"]["type"] == "ByteLevel" and ids == sorted(ids) and len(vocab.keys() - special.keys()) == 256 + len(ids):
        import public_tokenizers
        import tiktoken

        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in w): i for w, i in vocab.items() if w not in special}
        fast = tiktoken.Encoding("vocabulary", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        names = list(special)

        def encode(text: str) -> list[int]:
            if any(s in text for s in names):
                return fast.encode(text, allowed_special="all")
            return fast.encode_ordinary(text)

        return encode
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: slow.encode(text, add_special_tokens=False).ids


def _byte_letters() -> dict[str, int]:
    """The printable letter of each byte in byte-level vocabularies, by its public rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_pieces(docs: DataFrame, text: str = "text", vocabulary: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: the other columns, piece, start, length, ids (uint32, little-endian)."""
    path = vocabulary or vocabulary_path()
    (cut,) = spare_names(docs.columns, "pieces")

    def run(batches):
        encode = encoder(path)
        for b in batches:
            pieces = []
            for t in b.column(b.schema.get_field_index(text)).to_pylist():
                ids = array("I", encode(t) if t else ())
                ids.append(END_ID)
                first = len(ids) % capacity or capacity
                cuts = [0, *range(first, len(ids) + 1, capacity)]
                pieces.append([{"piece": k, "start": s, "length": e - s, "ids": ids[s:e].tobytes()} for k, (s, e) in enumerate(zip(cuts, cuts[1:]))])
            yield {cut: pieces}

    kind = "array<struct<piece:int,start:bigint,length:bigint,ids:binary>>"
    own = ("piece", "start", "length", "ids")
    rows = map_rows(docs, run, f"{cut} {kind}", drop=(text, *own))
    return rows.select(*[c for c in rows.columns if c != cut], F.inline(cut))


Key = tuple[int, tuple[tuple[int, int], ...]]

#: Levels of the search that keep their enumeration at hand; the others begin theirs anew when they are come back to.
LIVE = 16


def _reach(usable: list[int], spare: list[int], first: int, room: int) -> list[int]:
    """Per number of lengths taken from ``first`` on: the sums up to ``room`` they can make, as bits."""
    out, full = [1], (1 << (room + 1)) - 1
    for x, n in zip(usable[first:], spare[first:], strict=True):
        bits, left, step = out[-1], min(n, room // x), 1
        while left:
            take = min(step, left)
            bits |= bits << (take * x) & full
            left -= take
            step *= 2
        out.append(bits)
    return out


def _sums(usable: list[int], spare: list[int], reach: list[int], k: int, t: int) -> Iterator[tuple[tuple[int, int], ...]]:
    """Every choice of (length, copies) of the first k lengths that sums to t, long pieces and many copies first."""
    if not t:
        yield ()
        return
    for j in range(bisect_right(usable, t, 0, k) - 1, -1, -1):
        if not reach[j + 1] >> t & 1:
            return
        x = usable[j]
        for n in range(min(spare[j], t // x), 0, -1):
            if reach[j] >> (t - n * x) & 1:
                for rest in _sums(usable, spare, reach, j, t - n * x):
                    yield (x, n), *rest


def _fillings(counts: dict[int, int], capacity: int, after: Key | None = None) -> Iterator[tuple[Key, dict[int, int]]]:
    """All undominated fillings around the largest length, best first, with their place in that order; those up to ``after`` left out.

    A filling is dominated if a piece left over still fits, so the pieces that fit into what
    it leaves empty must all be in it; once they are too many, no emptier filling is undominated.
    """
    top = max(counts)
    room = capacity - top
    usable = sorted(x for x, n in counts.items() if x <= room and n > (x == top))
    spare = [counts[x] - (x == top) for x in usable]
    first, must, reach = 0, 0, None
    for t in range(room, -1, -1):
        while first < len(usable) and usable[first] <= room - t:
            must, first, reach = must + usable[first] * spare[first], first + 1, None
        if must > t:
            return
        if after and -t < after[0]:
            continue
        if reach is None:
            reach = _reach(usable, spare, first, room)
        if not reach[-1] >> (t - must) & 1:
            continue
        for parts in _sums(usable[first:], spare[first:], reach, len(usable) - first, t - must):
            whole = parts + tuple((usable[k], spare[k]) for k in range(first - 1, -1, -1))
            key = -t, tuple((-x, -n) for x, n in whole)
            if after is None or key > after:
                filling = dict(whole)
                filling[top] = filling.get(top, 0) + 1
                yield key, filling


def _choices(counts: dict[int, int], capacity: int, after: Key | None) -> Iterator[tuple[Key, dict[int, int], int]]:
    """Fillings with how often to use them, most often first."""
    own = dict(counts)
    for key, filling in _fillings(own, capacity, after):
        for n in range(min(own[x] // c for x, c in filling.items()), 0, -1):
            yield key, filling, n


def complete_bins(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = 3000) -> list[tuple[dict[int, int], int]]:
    """Fillings and how often each is used, covering the histogram with few bins.

    Bins around one length are chosen in the order of their fillings, so no set of bins comes
    twice. One table of counts serves the whole search; a level holds its place in its
    enumeration, and only LIVE of them the enumeration itself.
    """
    counts = {k: v for k, v in histogram.items() if v}
    tokens = sum(k * v for k, v in counts.items())
    bound = max(-(-tokens // capacity), sum(v for k, v in counts.items() if 2 * k > capacity))
    best, least, used, seen = None, None, 0, 0
    levels: list[list] = []  # after, choices taken, their enumeration or None, the last choice
    after = None
    while counts or levels:
        if counts:
            levels.append([after, 0, _choices(counts, capacity, after), None])
            if len(levels) > LIVE:
                levels[-LIVE - 1][2] = None
        else:
            if least is None or used < least:
                best, least = [level[3][1:] for level in levels], used
            if least == bound:
                break
            used, tokens = _undo(levels[-1], counts, used, tokens)
        while levels:
            level = levels[-1]
            if level[2] is None:
                level[2] = islice(_choices(counts, capacity, level[0]), level[1], None)
            level[3] = next(level[2], None)
            if level[3] is None:
                levels.pop()
                if levels:
                    used, tokens = _undo(levels[-1], counts, used, tokens)
                continue
            level[1] += 1
            key, filling, n = level[3]
            left = tokens - n * sum(x * c for x, c in filling.items())
            if least is not None:
                seen += 1
                if seen > nodes:
                    return best
                if used + n + -(-left // capacity) >= least:
                    continue
            top = max(counts)
            for x, c in filling.items():
                counts[x] -= c * n
                if not counts[x]:
                    del counts[x]
            used, tokens = used + n, left
            after = key if top in counts else None
            break
        else:
            break
    return best or []


def _undo(level: list, counts: dict[int, int], used: int, tokens: int) -> tuple[int, int]:
    """Take back a level's choice."""
    _, filling, n = level[3]
    for x, c in filling.items():
        counts[x] = counts.get(x, 0) + c * n
    return used - n, tokens + n * sum(x * c for x, c in filling.items())


def _slots(fillings: list[tuple[dict[int, int], int]]) -> list[np.ndarray]:
    """Sorted keys (length, first rank), and first sequence, copies and offset of each slot."""
    rows, ranks, sequence = [], {}, 0
    for filling, n in fillings:
        offset = 0
        for x, c in sorted(filling.items(), reverse=True):
            rows.append((x, ranks.get(x, 0), sequence, c, offset))
            ranks[x] = ranks.get(x, 0) + c * n
            offset += c * x
        sequence += n
    rows.sort()
    return [np.array(c, np.int64) for c in zip(*rows)] if rows else [np.zeros(0, np.int64)] * 5


def pack(pieces: DataFrame, keys: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY, rows_per_bucket: int = 1000) -> DataFrame:
    """``pieces`` (with length) plus sequence_id and offset. Reads ``pieces`` twice: hand in a stage."""
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    x, rank, sequence, copies, offset = _slots(complete_bins(histogram, capacity))
    sent = spark.sparkContext.broadcast((x * (1 << 44) + rank, rank, sequence, copies, offset))
    buckets = min(10_000, 1 + max(histogram.values(), default=0) // rows_per_bucket)
    bucket, many, base, place = spare_names(pieces.columns, "bucket", "many", "base", "rank")
    dealt = pieces.withColumn(bucket, F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy("length", bucket).agg(F.count("*").alias(many))
    before = F.sum(many).over(Window.partitionBy("length").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1))
    bases = totals.select("length", bucket, F.coalesce(before, F.lit(0)).alias(base))
    numbered = (
        dealt.join(bases.hint("shuffle_merge"), ["length", bucket])
        .withColumn(place, F.col(base) + F.row_number().over(Window.partitionBy("length", bucket).orderBy(*keys)) - 1)
        .drop(base, bucket)
    )

    def run(batches):
        key, first_rank, first_sequence, times, at = sent.value
        for b in batches:
            length = b.column(b.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            own = b.column(b.schema.get_field_index(place)).to_numpy(zero_copy_only=False)
            k = np.searchsorted(key, length.astype(np.int64) * (1 << 44) + own, side="right") - 1
            past = own - first_rank[k]
            yield {
                "sequence_id": pa.array(first_sequence[k] + past // times[k], pa.int64()),
                "offset": pa.array(at[k] + past % times[k] * length, pa.int64()),
            }

    return map_rows(numbered, run, "sequence_id long, offset long", drop=(place,)).select(
        *[c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")], "sequence_id", "offset"
    )


def pack_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", vocabulary: str | None = None, capacity: int = CAPACITY, keep_ids: bool = True) -> DataFrame:
    """Tokenize, cut and pack whole documents; ``ids_crc32`` always, ``ids`` if asked for."""
    pieces = token_pieces(docs, text, vocabulary, capacity).withColumn("ids_crc32", F.crc32("ids"))
    return pack(materialize(pieces if keep_ids else pieces.drop("ids"), "pieces"), (key, "piece"), capacity)
