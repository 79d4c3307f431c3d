"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from airtrace.llm import (
    bitsliced, bpe, decontam, licenses, merkle, oracles as sql, quality, runs, secrets, sharding, simhash, suffix, toolcalls,
    vocabulary, warc,
)
from airtrace.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_licenses", F.array_join("licenses", ",").alias("licenses"), "spans")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results, others = toolcalls.replies(table(spark, sf_dir, "conversations"))
    linked = toolcalls.link_tool_calls(calls, results, toolcalls.REPLY_SCHEMA, others)
    return linked.select(
        "conv_id", "kind", "call_id", "turn", "level", "place", "status", "valid", F.sha2("canonical", 256).alias("canonical_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = suffix.remove_repeats(table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(table(spark, sf_dir, "documents"), vocabulary.word_bpe())


def op11_bit_sliced_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), every=100)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify_received(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.run_digests(runs.collapse_runs(table(spark, sf_dir, "documents"), runs.planted))


def queries() -> dict[str, Query]:
    found = [
        op1_benchmark_decontamination, op2_license_scan, op3_chat_formatting, op4_simhash, op5_suffix_array,
        op6_warc, op7_secret_scan, op8_sharding, op9_quality_rules, op10_bpe,
        op11_bit_sliced_top_k, op12_merkle_manifest, op13_periodic_runs,
    ]
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    return sql.oracles()
