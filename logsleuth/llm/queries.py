"""The registered queries of the numbered operators, over their whole tables."""

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from logsleuth.llm import (
    bpe, embedding_dedup, filter_audit, language, license_scan, line_dedup, minhash, oracle, packing, pii, quality,
    resample, token_counts, toxicity,
)
from logsleuth.llm.texts import id_and_text, read_table

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return id_and_text(read_table(spark, sf_dir, "documents"))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir), VOCABULARY)
    return bpe.decode(encoded, VOCABULARY).select(
        "doc_id",
        bpe.n_ids().alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


def span_list(spans) -> Column:
    """kind:start:end of spans, comma-joined."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = pii.personal_data(docs, pii.fit(docs))
    base = F.filter("spans", lambda s: s["base"])

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(kind) for kind in pii.KINDS[:4]]
    return found.select(
        "doc_id", *counts, F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list("spans").alias("spans")
    )


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    kept = line_dedup.drop_lines(docs, line_dedup.LineIndex.build(docs))
    return kept.select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(documents(spark, sf_dir), VOCABULARY)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir)).drop("spans")


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select(
        "doc_id",
        toxicity.held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("passages").cast("long").alias("n_passages"),
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_links(read_table(spark, sf_dir, "embeddings"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", F.array_join("failed", ",").alias("failed_rules"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(documents(spark, sf_dir), VOCABULARY)
    return packing.pack(encoded).select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
        "sequence_id", "offset",
    )


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return language.languages(docs, language.fit(docs)).select(
        "doc_id",
        language.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(documents(spark, sf_dir), read_table(spark, sf_dir, "benchmark"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(*(read_table(spark, sf_dir, t) for t in ("documents", "labels")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe, op2_pii, op3_line_dedup, op4_token_counts, op5_license_scan, op6_minhash, op7_toxicity,
        op8_embedding_dedup, op9_quality_rules, op10_packing, op11_language, op12_resample, op13_filter_audit,
    )
}

ORACLE = {
    "op3_line_dedup": oracle.LINE_DEDUP,
    "op8_embedding_dedup": oracle.EMBEDDING_LINKS,
    "op9_quality_rules": oracle.quality_rules(quality.STOP_SPELLINGS),
    "op12_resample": oracle.RESAMPLE,
    "op13_filter_audit": oracle.FILTER_AUDIT,
}
