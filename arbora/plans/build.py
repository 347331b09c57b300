"""From a source tree to an index."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.functions import models
from arbora.functions.text import compress, node_text, snippet
from arbora.operators import bm25
from arbora.sources import extract, source_tree
from arbora.sources.shared import materialize
from arbora.sources.sinks import IndexFiles, meta


@dataclass
class BuildConfig:
    """summarize: None for none. scope: ``files`` or ``structured`` (files, classes and functions). answers: the folder of the model's finished answers; by default below the index."""

    summarize: models.Summarize | None = None
    min_loc: int = 20
    scope: str = "structured"
    callsites: int = extract.CALLSITES
    vocabulary: int | None = bm25.VOCABULARY
    answers: str | None = None

    def __post_init__(self) -> None:
        if self.scope not in ("files", "structured"):
            raise ValueError(f"unknown scope {self.scope!r}")
        if self.callsites <= 0:
            self.callsites = extract.CALLSITES


def summarized(nodes: DataFrame, files: DataFrame, config: BuildConfig) -> DataFrame:
    """``nodes`` with the model's summaries where they have none and are long enough."""
    work = extract.summary_work(nodes, config.min_loc)
    work = work.filter("kind = 'file'") if config.scope == "files" else work
    body = F.when(F.col("kind") == "file", compress(F.col("text"))).otherwise(snippet(F.col("text"), F.col("start_line"), F.col("end_line")))
    told = models.summarize(work.select("node_id", "path", "kind", "start_line", "end_line").join(files.select("path", "text"), "path").select("node_id", body.alias("body")), "body", config.summarize, into="_told", store=config.answers)
    both = nodes.join(told.select("node_id", "_told").dropDuplicates(["node_id"]), "node_id", "left")
    return both.withColumn("summary", F.coalesce("summary", "_told")).select(*nodes.columns)


def node_summaries(files: DataFrame, config: BuildConfig) -> DataFrame:
    """(node_id, summary) as of summarized(), of files (path, text) alone: a task cuts what the model sees from the files it reads, and each node is stored once."""
    work = F.col("kind").isin(*(extract.SUMMARISED if config.scope == "structured" else ("file",))) & (F.col("loc") >= config.min_loc) & F.col("summary").isNull()
    body = F.when(work, F.when(F.col("kind") == "file", compress(F.col("body"))).otherwise(F.col("body")))
    nodes = materialize(extract.only(files, "nodes", "body", bodies=config.min_loc).select("node_id", "summary", body.alias("body")), "bodies")
    told = models.summarize(nodes.filter("body is not null").select("node_id", "body"), "body", config.summarize, store=config.answers)
    return nodes.filter("body is null").select("node_id", "summary").unionByName(told.select("node_id", "summary"))


def build(spark: SparkSession, root: str, out: str, config: BuildConfig | None = None) -> DataFrame:
    """Builds the index of the tree at ``root`` in the folder ``out``; gives its meta row."""
    config, target = config or BuildConfig(), IndexFiles(spark, out)
    config = replace(config, answers=config.answers or f"{out}/answers")
    read = source_tree.contents(spark, root)
    files = target.write("files", source_tree.texts(read))
    found = extract.index(files, cap=config.callsites)
    folders = source_tree.folder_nodes(files, root).withColumnRenamed("path", "_path")
    owner = folders.filter("kind = 'pkg'").select(F.col("node_id").alias("_pkg"), "_path")
    at = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(".")
    nodes = extract.ordered(found["nodes"]).withColumn("_at", at).join(owner, F.col("_at") == F.col("_path"), "left")
    nodes = nodes.withColumn("parent_id", F.coalesce("parent_id", "_pkg")).drop("_at", "_pkg", "_path")
    if config.summarize:
        nodes = summarized(nodes, files, config)
    above = folders.select(F.lit(0).cast("int").alias("ord"), "node_id", "parent_id", "kind", F.col("_path").alias("path"), F.element_at(F.split("_path", "/"), -1).alias("symbol"))
    nodes = target.write("nodes", above.unionByName(nodes, allowMissingColumns=True))
    edges = target.write("edges", found["edges"])
    target.write("callsites", found["callsites"])
    target.write("stats", found["stats"])
    target.write("errors", found["errors"].unionByName(source_tree.faults(read)))
    inside = nodes.filter("kind not in ('repo', 'pkg')")
    texts = target.write("texts", inside.select("node_id", node_text(F.col("path"), F.col("symbol"), F.col("signature"), F.col("summary")).alias("text")))
    bm25.Index.build(texts, "node_id", F.col("text"), f"{out}/bm25", vocabulary=config.vocabulary)
    return target.write("meta", meta(nodes, edges))
