"""A training corpus from raw documents, stage by stage.

Toxic documents go; one document of each group of near-duplicates stays; personal data is masked;
sources are mixed to target weights; what is left is encoded. Every stage takes the documents that
its predecessor kept, written as Parquet and read again, and all but the last return the columns of
documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fairshare.llm import mixing, pieces, pii, queries, shingles, toxicity
from fairshare.llm.texts import count_words
from fairshare.sources.tables import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic; null and empty texts stay if it says so."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~queries.held_out(F.col("doc_id")))
    learned = docs.select("doc_id", "text").where(~queries.held_out(F.col("doc_id")))
    model = toxicity.train(learned, labels)
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text")
    return toxicity.score(own, model).where(F.col("score") < queries.TOXIC).select("doc.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group: that with the least id.

    SimHash fingerprints of five-word shingles, joined by their tries, give the first links; a link
    stands if the Jaccard similarity of the shingles is 0.8 or more. Pairs that near that differ in too
    many bits for the tries are found by bands of least hashes and checked in the same way.
    """
    return shingles.keep_one(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind, ``n_chars`` counted anew."""
    return pii.redact(docs).withColumn("n_chars", F.char_length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once, or up to three times."""
    identity = [F.col("doc_id"), F.col("source"), F.col("text")]
    mixed = mixing.mix(docs, count_words(F.col("text")), F.array("source"), identity, queries.cycling_weights)
    return mixing.repeated(mixed)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, ids) of every document."""
    coded = pieces.encode(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_pieces"), "ids")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode),
]

#: Not expressible: a learned classifier, XXH64 and SentencePiece are no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
