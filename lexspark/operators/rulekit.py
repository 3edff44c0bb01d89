"""What the rules for risks and inconsistencies share: one shape of finding, ranking and limits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import severity_rank
from ..shared import by_document

COLUMNS = ["document_id", "rule_id", "category", "severity", "clause_id", "entity_id", "title"]


def finding(rows: DataFrame, rule_id: str, category: str, severity: str | Column, title: Column, clause_id: Column | None = None, entity_id: Column | None = None) -> DataFrame:
    """Rows of one rule in the common shape."""
    null = F.lit(None).cast("string")
    return rows.select(
        "document_id", F.lit(rule_id).alias("rule_id"), F.lit(category).alias("category"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"),
        (null if clause_id is None else clause_id).cast("string").alias("clause_id"), (null if entity_id is None else entity_id).cast("string").alias("entity_id"), title.alias("title"),
    )


def run(findings: list[DataFrame], per_rule: int, total: int, dealt: bool = False) -> DataFrame:
    """Of each rule the gravest, then by title, up to ``per_rule``; then each once; then the gravest up to ``total``.

    ``place`` is the order in the document; ``finding_id`` depends on the finding's content only.
    Findings are dealt out once, by document; those of ``dealt`` tables stay where they lie.
    """
    every = by_document(reduce(DataFrame.unionByName, findings), dealt)
    rank = severity_rank(F.col("severity"))
    tie = ["title", F.coalesce("clause_id", F.lit("")), F.coalesce("entity_id", F.lit(""))]
    own = Window.partitionBy("deal", "document_id", "rule_id").orderBy(rank, *tie)
    some = every.withColumn("r", F.row_number().over(own)).where(F.col("r") <= per_rule).drop("r")
    once = some.dropDuplicates(["deal", *COLUMNS])
    whole = Window.partitionBy("deal", "document_id").orderBy(rank, "rule_id", *tie)
    placed = once.withColumn("place", F.row_number().over(whole)).where(F.col("place") <= total).drop("deal")
    ident = F.sha2(F.concat_ws("|", "rule_id", F.coalesce("clause_id", F.lit("")), F.coalesce("entity_id", F.lit("")), "title"), 256)
    return placed.withColumn("finding_id", F.concat(F.lit("f_"), F.substring(ident, 1, 12)))


def counts(findings: DataFrame) -> DataFrame:
    """Findings of each document by rule and severity."""
    return findings.groupBy("document_id", "rule_id", "severity").agg(F.count("*").alias("n"))


def duplicates(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Our findings that a provider's table ``(document_id, id, clause_id, category)`` also has, on clause and category."""
    t = theirs.select("document_id", "clause_id", "category", F.col("id").alias("provider_id"))
    return ours.join(t, ["document_id", "clause_id", "category"]).select("document_id", "finding_id", "provider_id")
