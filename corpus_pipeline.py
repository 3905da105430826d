"""From raw documents to packed training sequences, stage by stage.

Every stage takes the documents its predecessor kept, as read back from Parquet, and all but
the last return the columns of ``documents``:

1. toxicity: documents scored 0.5 or more go (labels of every fifth document are not learnt);
2. near_dedup: one document, the smallest id, stays of each group of near duplicates;
3. suffix_dedup: strings of 200 bytes (a passage of some 40 words) that occurred earlier in the corpus are cut out, in whole
   characters; a document of which nothing is left goes; n_chars follows the text;
4. decontamination: documents that hold a ten-word window of the benchmark go;
5. packing: what is left is tokenized and packed into sequences of 2048 ids.

Defined cases: null, empty and blank texts are clean, unlike any other, hold nothing to cut and
pass all stages as they are; texts of any length are read whole; rows repeated with their id
and text are one document and are kept, dropped and cut alike; rows with a null id stay in
stages 1, 2 and 4 and come first in the order of stage 3; of equal strings the one with the
smallest id, then position, stays; an empty table gives no rows; other columns of documents
pass through the first four stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanegraph.llm import decontamination, near_dedup, packing, suffix_dedup, toxicity
from lanegraph.session import ship
from lanegraph.stage import materialize
from lanegraph.tables import table

#: Strings of this many bytes that were found before are cut.
REPEATED_BYTES = 200


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose score is under 0.5; trained on the labels of four fifths of the ids."""
    ship(spark)
    learnt = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").filter(learnt)
    return toxicity.toxicity(docs, labels).filter("score < 0.5").select(docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that have no near duplicate, or are the smallest id of their group."""
    ship(spark)
    return near_dedup.keep_firsts(docs).select(docs.columns)


def cut_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the strings found earlier; those of which nothing is left go."""
    ship(spark)
    cut = suffix_dedup.deduplicate(docs, length=REPEATED_BYTES, keep="first").filter("n_bytes = 0 or octet_length(kept_bytes) > 0")
    text = F.when(F.col("text").isNotNull(), F.col("kept_bytes").cast("string"))
    return cut.withColumn("text", text).withColumn("n_chars", F.length("text").cast("bigint")).select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no window of the benchmark."""
    ship(spark)
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).filter(F.size("hit_spans") == 0).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their place in sequences."""
    ship(spark)
    packed = packing.pack_documents(docs.select("doc_id", "text"), keep_ids=False)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("suffix_dedup", cut_repeated_strings),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: A trained model, iterated links and a search for bins are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each stage written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
