"""The registered queries: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm import bpe, decontaminate, embedding_neighbours, html_extract, language_id, line_dedup, merkle, packing, quality_rules, simhash, suffix_dedup, toxicity, word_runs
from tracemill.llm.common import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hex16(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def tokenizer_path() -> str:
    """The public vocabulary file; only the driver reads it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_embedding_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embedding_neighbours.near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train(docs, language_id.learnable()))
    return found.select("doc_id", (~language_id.learnable()).alias("held_out"), "lang_pred", "score", "rejected")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.learnable())
    found = toxicity.scored(docs.select("doc_id", "text"), model).select("row.doc_id", "score")
    return found.select("doc_id", (~toxicity.learnable()).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and removed, and the hash of the text that is left (null for null)."""
    rows = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return rows.select("row.doc_id", "n_lines", "n_removed", F.sha2("new_text", 256).alias("kept_sha256"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.decoded(bpe.encoded(table(spark, sf_dir, "documents"), tokenizer_path()), tokenizer_path())
    return rows.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)
    return found.select("doc_id", hex16("fp").alias("fingerprint"), "component_id")


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are the texts that ``labels.quality`` marks 1."""
    docs = table(spark, sf_dir, "documents")
    ratios = quality_rules.fit(docs, table(spark, sf_dir, "labels").where("quality = 1"))
    found = quality_rules.assess(docs.select("doc_id", "text"), ratios)
    return found.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio")


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=("doc_id",))
    return rows.select(
        "row.doc_id",
        "n_words",
        decontaminate.n_words_in(F.col("spans")).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merkle.document_manifest(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 == 0)
    folded = found.withColumn("folded_root", merkle.fold(F.coalesce("data", "leaf"), F.col("path")))
    return folded.select(
        F.col("key").alias("doc_id"),
        "leaf",
        "subroot",
        "root",
        merkle.proof_digest(F.col("path")).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def op13_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = word_runs.collapse(word_runs.with_repeated_tails(table(spark, sf_dir, "documents")), keep=("doc_id",))
    top = word_runs.longest(F.col("runs"))
    found = rows.select("row.doc_id", F.size("runs").cast("bigint").alias("n_runs"), "runs", "collapsed", top.alias("top"))
    return found.select(
        "doc_id",
        "n_runs",
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        word_runs.digest(F.col("runs")).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_embedding_neighbours": op2_embedding_neighbours,
    "op3_language_id": op3_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_line_dedup": op6_line_dedup,
    "op7_bpe": op7_bpe,
    "op8_simhash": op8_simhash,
    "op9_html_extract": op9_html_extract,
    "op10_quality_rules": op10_quality_rules,
    "op11_decontaminate": op11_decontaminate,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_word_runs": op13_word_runs,
}
ORACLE: dict[str, str] = {
    "op6_line_dedup": line_dedup.ORACLE_SQL,
    "op11_decontaminate": decontaminate.ORACLE_SQL,
    "op12_merkle_manifest": merkle.ORACLE_SQL,
    "op13_word_runs": word_runs.ORACLE_SQL,
}
