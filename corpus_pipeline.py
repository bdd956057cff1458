"""The corpus pipeline: five stages of the operators in ``tidewater.llm``, each over all its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import langid, mixing, pieces, quality, simhash
from tidewater.session import cut_lineage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is probably of the best grade, by the ratings of the label table."""
    rated = quality.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.select_quality(docs, rated)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which learned languages explain at least half; unlearned ones, random letters and texts without letters go."""
    return langid.select_identified(docs, langid.fit_languages(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group (4-word shingles, 4 bits): the one with the smallest id."""
    return simhash.drop_copies(docs, width=4, radius=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that each source's words meet its target."""
    return mixing.mixed_rows(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding them gives the text back."""
    return pieces.encode(docs).select(
        "doc_id", "source", "lang", "_tw_pieces.ids", F.size("_tw_pieces.ids").alias("n_ids"), "_tw_pieces.round_trip"
    )


STAGES = [
    ("quality", keep_quality),
    ("language", keep_language),
    ("copies", drop_copies),
    ("mix", mix_sources),
    ("pieces", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return docs


# No SQL can train the classifiers, walk the links of near-duplicates or segment words; tests/llm holds
# the stages against plain Python.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
