"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_ivfpq, best_position, bpe_tree, chat_hmm, compaction, oracles, packing, prefix_hash, quality_rules, secret_scan, simhash, substring_dedup, turn_repair, url_filter
from .common import new_path, table, words

#: The rules of op8, (host, path, verdict).
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
#: Pages with less visible text than this are listed, by canonical URL.
THIN_PAGE_CHARS = 1200


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = secret_scan.findings(docs, repo=F.concat_ws("/", "source", "lang"), owner=F.col("source"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(secret_scan.spans_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.spans_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
        "n_live",
        "n_copied",
    )


def listed_urls(pages: DataFrame) -> DataFrame:
    """Canonical URLs of the pages with little visible text."""
    seen = F.length(F.regexp_replace(F.coalesce("html", F.lit("")), "<[^>]*>", ""))
    return pages.filter(seen < THIN_PAGE_CHARS).select(url_filter.canonical(F.col("url")).alias("canon"))


def op2_bpe_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_tree.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


#: Fixed shares of documents that op3 takes as arrivals: parts of eight.
ARRIVALS = ((0, 4), (4, 6), (6, 7), (7, 8))
SHARD_BYTES = 64 << 20


def op3_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each document is stored after four arrivals and a compaction; row_key is a hash of its stored columns."""
    docs = table(spark, sf_dir, "documents")
    store = compaction.Store(spark, new_path(spark, "store"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(8))
    for a, b in ARRIVALS:
        store.append(docs.filter((part >= a) & (part < b)))
    version = store.compact(target=SHARD_BYTES)
    store.vacuum()
    rows = store.read(version)
    if rows is None:
        rows = docs.limit(0).withColumn("_metadata", F.struct(F.lit("").alias("file_path"), F.lit(0).cast("long").alias("file_size")))
    return rows.select("doc_id", F.regexp_extract("_metadata.file_path", compaction.NAME, 1).alias("shard"), F.col("_metadata.file_size").alias("shard_bytes"), F.lit(version).alias("version"), F.xxhash64("doc_id", "text", "lang", "source", "n_chars").alias("row_key"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_transcript_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw transcripts, and what the model recovers: each turn's role, and its canonical text. ``right``: the role is the turn's own."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").alias("part"), "role", "text")
    raw = chat_hmm.raw_parts(turns)
    model = chat_hmm.train(chat_hmm.learning(raw))
    own = raw.groupBy("conv", "part", F.xxhash64("text").alias("k")).agg(F.min("role").alias("role")).alias("o")
    told = chat_hmm.decode(raw, model).withColumn("k", F.xxhash64("text")).alias("t")
    both = told.join(own, F.expr("t.conv <=> o.conv and t.part <=> o.part and t.k = o.k"))
    return both.select(F.col("t.conv").alias("conv_id"), F.col("t.part").alias("turn"), F.col("t.roles")[0].alias("role"), F.size("t.roles").alias("n_lines"), F.coalesce(F.col("t.roles")[0] == F.col("o.role"), F.lit(False)).alias("right"), "t.rendered")


def op6_ivf_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_ivfpq.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.strip(table(spark, sf_dir, "documents"), digest=True)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.judge(pages, listed_urls(pages), URL_RULES)


def op9_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return packing.pack(packing.pieces(docs, F.size(words(F.col("text")))))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = turn_repair.damage(table(spark, sf_dir, "conversations"))
    return turn_repair.repair(turns, F.col("copies"))


def op12_best_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_position.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("item_id", "rank", "doc_id", "score")


def op13_prefix_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_hash.chain(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_secret_scan, op2_bpe_tree, op3_compaction, op4_quality_rules, op5_transcript_hmm, op6_ivf_pq, op7_substring_dedup, op8_url_filter, op9_best_fit, op10_simhash, op11_turn_repair, op12_best_position, op13_prefix_hash)}
SQL: dict[str, str] = {"op1_secret_scan": oracles.op1(), "op4_quality_rules": oracles.OP4, "op7_substring_dedup": oracles.OP7, "op8_url_filter": oracles.op8(URL_RULES, THIN_PAGE_CHARS), "op12_best_position": oracles.OP12}
