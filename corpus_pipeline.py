"""A corpus pipeline: language filter, near-dedup, redaction, source mixing, piece encoding.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; :func:`run` writes each result
as Parquet and reads it back for the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.llm import langid, mixing, pieces, pii, superminhash
from lexspark.llm.common import materialize


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents whose language is not found: no letter, or far from every learnt language."""
    trees = langid.train(docs.where(~langid.held_out()))
    return langid.accepted(docs, trees)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep of each near-duplicate group the row with the smallest doc_id, and of repeated rows one; see :func:`superminhash.survivors`."""
    return superminhash.survivors(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by its kind in brackets, and count the characters again."""
    out = pii.redacted(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or drop documents so that the words of each source come to its target."""
    plan = mixing.mix(docs).where("taken > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("size").alias("__size"), (F.col("taken") / F.col("size")).cast("int").alias("__times")).distinct()
    sized = docs.withColumn("__words", mixing.n_words("text"))
    taken = sized.join(plan, sized["doc_id"].eqNullSafe(plan["__id"]) & sized["source"].eqNullSafe(plan["__source"]) & (sized["__words"] == plan["__size"]))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__times"))).select(docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, with what they decode to compared."""
    return pieces.encode(docs)


STAGES = [
    ("language", keep_languages),
    ("near_dedup", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("mixing", mix_sources),
    ("pieces", encode_pieces),
]

#: Byte context trees, keyed hashes and merge agendas are not expressible in SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
