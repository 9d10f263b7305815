"""Registered queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadspark.llm import decontam, fmindex, importance, license, merkle, packing, pii, quality, repeats, runlength, sharding, simhash, tokencodes, urltree
from threadspark.llm import oracles as sql
from threadspark.llm.common import ship_code, table
from threadspark.llm.encoder import vocabulary_path

BYTE_VOCABULARY, WORD_VOCABULARY = "byte_bpe_50k.json", "word_bpe_49k.json"


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every line of every document."""
    r = license.scan_licenses(table(spark, sf_dir, "documents"))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",").alias(c)
    return r.select("doc_id", "n_words", "n_base", "first_word", "last_word", join("base_labels"), join("labels"), "score")


def _removed(r: DataFrame) -> list:
    spans = F.col("spans")
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return [total.alias("n_removed"), F.size(spans).cast("long").alias("n_spans"), F.sha2(F.col("kept"), 256).alias("kept_sha256")]


def op2_run_length_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes covered by 50-byte strings that also start in a smaller document are removed."""
    r = repeats.remove_repeats(table(spark, sf_dir, "documents"), runlength.RunLengthIndex, words=False, length=50, gram=24, null_last=False)
    return r.select("doc_id", F.col("n_units").alias("n_bytes"), *_removed(r))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash components of all documents."""
    r = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return r.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


def op4_fm_index_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words covered by 13-word windows that also start in a smaller document are removed."""
    r = repeats.remove_repeats(table(spark, sf_dir, "documents"), fmindex.FMIndex, words=True, length=13, gram=4, null_last=False)
    removed, _, digest = _removed(r)
    return r.select("doc_id", F.col("n_units").alias("n_words"), removed, digest)


def op5_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and path-template purity over all pages."""
    return urltree.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).select("page_id", "host", "path", "rule", "verdict", "template")


def op6_benchmark_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return decontam.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files written in document order and read back."""
    path = tokencodes.scratch_path(spark, "tokens")
    tokencodes.write_tokens(table(spark, sf_dir, "documents"), path, vocabulary_path(BYTE_VOCABULARY))
    return tokencodes.read_tokens(spark, path)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path(WORD_VOCABULARY))


def op9_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it."""
    r = pii.personal_data(table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return r.select(
        "doc_id", *[count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS[:4])],
        F.sha2(pii.span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"),
    )


def op10_quality_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality rules as votes, weighed by expectation-maximisation."""
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_uniform_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents shuffled into 16 shards whose row counts are at most one apart."""
    return sharding.shard_table(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Merkle tree of all documents by language, each leaf checked against the root."""
    return merkle.verify(table(spark, sf_dir, "documents"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn by how much their features look like the benchmark's."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def _shipped(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_code(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {
    f.__name__: _shipped(f)
    for f in (
        op1_license_scan, op2_run_length_dedup, op3_simhash_dedup, op4_fm_index_dedup, op5_url_templates,
        op6_benchmark_containment, op7_token_codes, op8_best_fit_packing, op9_disclosure, op10_quality_votes,
        op11_uniform_shards, op12_merkle_manifest, op13_importance_resampling,
    )
}
ORACLES = {
    "op1_license_scan": sql.license_scan(),
    "op2_run_length_dedup": sql.BYTE_REPEATS,
    "op4_fm_index_dedup": sql.WORD_REPEATS,
    "op5_url_templates": sql.url_templates(),
    "op6_benchmark_containment": sql.CONTAINED,
    "op12_merkle_manifest": sql.merkle_manifest(),
    "op13_importance_resampling": sql.importance(),
}
