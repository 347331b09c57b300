"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it works on all
that the stage before kept. All but the last return the columns of documents.

Defined results, stage by stage (the operators' docstrings say more):

* quality: null, empty and blank texts go, as all of fewer than ten words; of
  repeated rows each is judged alike; a null language is a stratum of its own.
* near_dedup: of texts that are linked, repeated rows among them, the row of the
  least id stays, a null id only where there is no other; null and blank texts
  are copies of each other.
* passage_dedup: null and short texts stay as they are; repeated rows lose what
  they share; a text of repeated passages alone becomes empty.
* secrets: null texts stay null; overlapping credentials give one mark.
* packed: null and empty texts give no piece; very long ones several; repeated
  rows are packed each; ties go by id, then piece.

Texts of any length are taken whole; an empty table gives no rows; other columns
than those of documents are dropped, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import bpe_tree, packing, quality_rules, secret_scan, simhash, substring_dedup
from arbora.llm.common import new_path, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _columns(docs: DataFrame, length: Column | None = None) -> DataFrame:
    """The columns of documents; n_chars as given, or that of the new text."""
    return docs.withColumn("n_chars", F.length("text").cast("long") if length is None else length).select(*COLUMNS)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: those of 0.8 or more alike in their 5-word shingles."""
    return simhash.keep_similar(docs.select(*COLUMNS))


def passage_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of repeated passages go; documents stay, if need be with an empty text."""
    return _columns(substring_dedup.strip(docs.select(*COLUMNS)))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials give way to a mark."""
    docs = docs.select(*COLUMNS)
    found = secret_scan.findings(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    return _columns(secret_scan.redact(docs, found))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, in BPE tokens, with their places in bins."""
    import public_tokenizers

    counted = bpe_tree.counts(docs, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(packing.pieces(counted, F.col("n_tokens")))


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("passage_dedup", passage_dedup), ("secrets", secrets), ("packed", packed)]

#: Components and exact repeats of the middle stages are beyond SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
