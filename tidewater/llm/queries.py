"""Registered queries of this subpackage, with production parameters on the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import codes, langid, licenses, lm, merkle, mixing, neardup_vectors, pieces, quality, queries_sql, sharding, simhash, variants, warc
from tidewater.llm.common import table


def _part(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 5; a null id counts as empty text."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(0)) % 5


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit_quality(docs, quality.graded(table(spark, sf_dir, "labels")))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", "_tw_quality.expected_grade", "_tw_quality.tail", (F.col("_tw_quality.tail") >= quality.LEAST).alias("selected"))


def op2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pieces.encode(docs).select(
        "doc_id", "_tw_pieces.ids", "_tw_pieces.score", F.size("_tw_pieces.ids").alias("n_ids"), "_tw_pieces.round_trip"
    )


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.score(table(spark, sf_dir, "documents"), _part() != 1)
    return scored.select(
        F.col("id").alias("doc_id"), (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"), notices=licenses.SHORT_NOTICES).withColumnRenamed("id", "doc_id")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"), width=4, radius=4)
    return groups.select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id")
    )


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 40).select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edits(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_languages(docs.filter(_part() != 0))
    found = langid.identify(docs, model)
    return found.select(
        "doc_id", (_part() == 0).alias("held_out"), F.col("_tw_language.lang").alias("lang_pred"), "_tw_language.score",
        F.array_join("_tw_language.set", " ").alias("languages"),
    )


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup_vectors.vector_groups(table(spark, sf_dir, "embeddings"), threshold=0.9)
    return groups.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


def op11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.spelling_variants(variants.word_counts(table(spark, sf_dir, "documents"), slip=97))


def op12_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.vector_codes(table(spark, sf_dir, "embeddings"))
    return codes.with_label_error(coded).select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.codebooks_digest(books)).alias("codebooks_sha256")
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_archives(table(spark, sf_dir, "pages"))
    return warc.read_records(index, bodies=False).select(
        F.col("page_id").cast("long").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        F.col("type").alias("record_type"), F.col("refers_to_page").cast("long").alias("refers_to"),
    )


QUERIES = {
    "op1_quality": op1_quality,
    "op2_pieces": op2_pieces,
    "op3_lm": op3_lm,
    "op4_licenses": op4_licenses,
    "op5_simhash": op5_simhash,
    "op6_sharding": op6_sharding,
    "op7_fingerprints": op7_fingerprints,
    "op8_language": op8_language,
    "op9_vectors": op9_vectors,
    "op10_mixing": op10_mixing,
    "op11_variants": op11_variants,
    "op12_codes": op12_codes,
    "op13_warc": op13_warc,
}
ORACLES = {"op11_variants": queries_sql.VARIANTS, "op12_codes": queries_sql.CODES, "op13_warc": queries_sql.ARCHIVE}
