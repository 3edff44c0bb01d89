"""The contract model over the derived corpus, in the shapes that the operators take."""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clauses import classify
from .corpus import AS_OF, corpus, dealt_lines


def as_of() -> Column:
    """The day on which the queries judge deadlines."""
    return F.lit(AS_OF).cast("date")


def model(spark: SparkSession, sf_dir: str, dealt: bool = False) -> SimpleNamespace:
    """The tables of the model; ``dealt`` ones lie by contract, all made of one exchange of the lines."""
    lines = dealt_lines(spark, sf_dir) if dealt else None
    views = "corpus_a", "corpus_b", "corpus_parties", "corpus_obligations", "corpus_rights", "corpus_deadlines", "corpus_conditions"
    a, b, parties, obligations, rights, deadlines, conditions = corpus(spark, sf_dir, *views, lines=lines)
    null = F.lit(None).cast("string")
    return SimpleNamespace(
        clauses=classify(a.select("document_id", "ord", "clause_id", "number", "heading", "text", "n_days")),
        a=a,
        b=b,
        parties=parties.select("document_id", F.col("party_id").alias("id"), "name", "role", F.array().cast("array<string>").alias("aliases")),
        obligations=obligations.select(
            "document_id", F.col("obligation_id").alias("id"), "ord", "clause_id", F.col("obligor_id").alias("obligor_party_id"), F.col("obligee_id").alias("obligee_party_id"), "deadline_id", "informational", "summary",
            F.when(F.col("has_consequence"), F.array(F.lit("x"))).otherwise(F.array().cast("array<string>")).alias("consequence_ids"), null.alias("consequence_text"), F.col("trigger_id").alias("trigger_condition_id"), null.alias("trigger_text"), null.alias("standard"),
        ),
        rights=rights.select("document_id", F.col("right_id").alias("id"), "ord", "clause_id", F.col("holder_id").alias("holder_party_id"), F.col("counterparty_id").alias("counterparty_party_id"), "summary"),
        deadlines=deadlines.select(
            "document_id", F.col("deadline_id").alias("id"), "ord", "clause_id", "date_type", "date", "offset_amount", F.when(F.col("offset_amount").isNotNull(), "day").alias("offset_unit"), null.alias("recurrence"), "anchor_date", "description", null.alias("event"), null.alias("anchor_event"),
        ),
        conditions=conditions.select("document_id", F.col("condition_id").alias("id"), "clause_id", "condition_type"),
        definitions=spark.createDataFrame([], "document_id bigint, id string, clause_id string, term string, text string"),
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
