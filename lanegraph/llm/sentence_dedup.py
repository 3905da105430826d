"""Substring deduplication by sliding spans of whole sentences.

Every run of ``run`` consecutive sentences of every document is hashed (two hashes of 64 bits);
per hash the count and the first place, in the order of (key, text hash, position), are partial
aggregates. Runs found again elsewhere are joined back to their documents, and the sentences
they cover are cut. No text travels with a run, and no task holds the runs of a hash; the join
to a hot one is a plain join that adaptive execution can split.

A sentence ends behind ``.!?`` with white space after it (closing quotes and brackets may stand
between), behind the CJK stops, or at a line's end, and holds the white space that follows it,
so the sentences of a text make up the text. They are compared byte by byte, without the white
space around them.

A cut sentence lies in a run that has an earlier copy, so the earliest copy of every sentence
is never cut: a run may go in parts, a sentence is never lost.

Defined cases: null text is empty; white space alone has no sentence and stays; texts of fewer
sentences than ``run`` keep everything; runs never cross documents, but may be repeated in one;
a row repeated with its id and text is one place in the order; null ids come first; texts of
any length are split whole; an empty table gives no rows; other columns pass through whatever
their names, but n_sentences, n_cut and kept_text are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanegraph.llm.common import SPACES, let, spare_names, whole_text
from lanegraph.stage import discard, materialize

RUN = 3
#: Positions up to this many are broadcast to the documents; more are joined by a shuffle.
SENT_ITEMS = 200_000

#: One sentence; Java's and RE2's syntax alike.
SENTENCE = r"""(?s)[\x20\x09-\x0D]*[^\x20\x09-\x0D].*?(?:[.!?]["'”’»)\]]*[\x20\x09-\x0D]+|[。！？]["'”’»)\]]*[\x20\x09-\x0D]*|\n[\x20\x09-\x0D]*|\z)"""


def sentences(text: Column) -> Column:
    """Array of the sentences, each with the white space around it."""
    return F.regexp_extract_all(text, F.lit(SENTENCE), 0)


def _runs(docs: DataFrame, key: str, text: str, run: int) -> DataFrame:
    """id, tid (text hash), pos, h and g (hashes) of every run."""

    def hashes(s: Column) -> Column:
        def one(i: Column) -> Column:
            own = [F.get(s, i + k) for k in range(run)]
            return F.struct(F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(run), *reversed(own)).alias("g"))

        return F.when(F.size(s) >= run, F.transform(F.sequence(F.lit(0), F.size(s) - run), one))

    bare = F.transform(sentences(whole_text(text)), lambda x: F.btrim(x, F.lit(SPACES)))
    rows = docs.select(F.col(key).alias("id"), F.xxhash64(whole_text(text)).alias("tid"), F.posexplode(let(bare, hashes)).alias("pos", "r"))
    return rows.select("id", "tid", "pos", "r.h", "r.g")


def repeated_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """id, tid, at: positions of the runs of each text that have an earlier copy."""
    runs = materialize(_runs(docs, key, text, run), "sentence-runs")
    place = F.struct("id", "tid", "pos")
    first = materialize(runs.groupBy("h", "g").agg(F.count("*").alias("n"), F.min(place).alias("first")).filter("n > 1").drop("n"), "sentence-runs-first")
    later = runs.join(first, ["h", "g"]).filter(~place.eqNullSafe(F.col("first")))
    out = materialize(later.groupBy("id", "tid").agg(F.collect_set("pos").alias("at")), "sentence-runs-repeated")
    discard(runs, first)
    return out


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", run: int = RUN) -> DataFrame:
    """``docs`` with n_sentences, n_cut (sentences) and kept_text, the text without the cut ones."""
    own, tid, at, new = spare_names(docs.columns, "id", "tid", "at", "made")
    found = repeated_runs(docs, key, text, run).toDF(own, tid, at)
    few = (found.agg(F.sum(F.size(at))).first()[0] or 0) <= SENT_ITEMS
    found = F.broadcast(found) if few else found
    same = F.col(key).eqNullSafe(F.col(own)) & (F.xxhash64(whole_text(text)) == F.col(tid))
    placed = docs.join(found, same, "left")
    covered = F.flatten(F.transform(at, lambda p: F.sequence(p, p + run - 1)))

    def cut(s: Column) -> Column:
        left = F.when(F.size(s) > 0, F.array_except(F.sequence(F.lit(0), F.size(s) - 1), covered))
        kept = F.when(F.col(at).isNull(), whole_text(text)).otherwise(F.array_join(F.transform(left, lambda i: F.get(s, i)), ""))
        n = F.size(s).cast("long")
        return F.struct(n.alias("n_sentences"), F.when(F.col(at).isNull(), F.lit(0)).otherwise(n - F.size(left)).cast("long").alias("n_cut"), kept.alias("kept_text"))

    made = ("n_sentences", "n_cut", "kept_text")
    return placed.select(*[c for c in docs.columns if c.lower() not in made], let(sentences(whole_text(text)), cut).alias(new)).select("*", f"{new}.*").drop(new)
