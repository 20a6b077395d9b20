"""One query for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lagweave.llm import bpe, exact_dedup, license_scan, line_dedup, mixing, ngram_join, quality, token_counts, toxicity, url_filter


def table(spark: SparkSession, sf: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet").select(*columns)


#: Second-level names of hosts that were labelled as unwanted by hand; every other URL of the table is labelled as wanted.
LABELLED_BAD = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
URL_RULES = [url_filter.UrlRule(*r) for r in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))]


def labelled_urls(pages: DataFrame) -> DataFrame:
    """(url, label, name): name is the second-level name of the host, empty without one."""
    name = F.coalesce(F.try_element_at(F.split(url_filter.host_of(F.col("url")), r"\."), F.lit(-3)), F.lit(""))
    return pages.select("url", name.isin(*LABELLED_BAD).cast("int").alias("label"), name.alias("name"))


def op1_url_filter(spark, sf):
    pages = table(spark, sf, "pages", "page_id", "url")
    model = url_filter.train(labelled_urls(pages))
    return url_filter.judge(pages, URL_RULES, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op3_mix_sources(spark, sf):
    x = mixing.mix_counts(table(spark, sf, "documents", "doc_id", "text", "source"))
    return x.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("copies") * F.col("_size")).alias("taken"))


def op4_toxicity(spark, sf):
    docs = table(spark, sf, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf, "labels", "doc_id", "toxic"))
    return toxicity.score(docs, model)


def op5_line_dedup(spark, sf):
    x = line_dedup.dedup_lines(table(spark, sf, "documents", "doc_id", "text"))
    return x.select("doc_id", "n_lines", "n_removed", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("text_sha256"))


def op6_ngram_jaccard(spark, sf):
    return ngram_join.near_duplicates(table(spark, sf, "documents", "doc_id", "text")).select("doc_id", "n_shingles", "component_id")


def op7_byte_bpe(spark, sf):
    x = bpe.encode(table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return x.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_license_scan(spark, sf):
    x = license_scan.scan(table(spark, sf, "documents", "doc_id", "text"))
    starts = F.transform("base_hits", lambda m: m["start"])
    base = F.array_sort(F.array_distinct(F.transform("base_hits", lambda m: m["label"])))
    return x.select(
        "doc_id", "n_words", F.size("base_hits").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), F.round("score", 6).alias("score"),
    )


def op2_exact_dedup(spark, sf):
    # The digest column needs every text; the operator itself hashes only those that may have copies.
    docs = table(spark, sf, "documents", "doc_id", "text")
    sha = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return exact_dedup.mark(docs.withColumn("text_sha256", sha)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_quality_rules(spark, sf):
    x = quality.judge(table(spark, sf, "documents", "doc_id", "text"))
    return x.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_counts(spark, sf):
    return token_counts.count_with_ranks(table(spark, sf, "documents", "doc_id", "text"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_mix_sources": op3_mix_sources,
    "op4_toxicity": op4_toxicity,
    "op5_line_dedup": op5_line_dedup,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_license_scan": op8_license_scan,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
}
