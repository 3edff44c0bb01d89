"""Validation of the contract model: one row for each issue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import validate_edges

ISSUE = ["document_id", "code", "severity", "entity_id"]


def _issue(rows: DataFrame, code: str, entity: Column, severity: str = "error") -> DataFrame:
    return rows.select("document_id", F.lit(code).alias("code"), F.lit(severity).alias("severity"), entity.cast("string").alias("entity_id"))


def required(table: DataFrame, columns: list[str]) -> DataFrame:
    """L1: missing values of required columns, in one pass."""
    each = F.array_compact(F.array(*[F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(f"missing-{c}")) for c in columns]))
    return table.select("document_id", F.explode(each).alias("code"), F.lit("error").alias("severity"), F.col("id").alias("entity_id")).select(ISSUE)


def vocabulary(table: DataFrame, column: str, words: list[str]) -> DataFrame:
    """L1: values outside a vocabulary; a warning."""
    return _issue(table.where(F.col(column).isNotNull() & ~F.col(column).isin(words)), f"unknown-{column}", F.col("id"), "warning")


def offsets(table: DataFrame) -> DataFrame:
    """L1, L2: half or reversed ranges."""
    a, b = F.col("start_offset"), F.col("end_offset")
    return _issue(table.where(a.isNull() != b.isNull()), "half-range", F.col("id")).unionByName(_issue(table.where(b < a), "reversed-range", F.col("id")))


def evidence(entities: DataFrame, quotes: DataFrame) -> DataFrame:
    """L2: entities without a quote, and quotes that are empty, unverified or of another document."""
    none = _issue(entities.join(quotes.select("document_id", F.col("entity_id").alias("id")), ["document_id", "id"], "left_anti"), "no-evidence", F.col("id"))
    blank = _issue(quotes.where(F.coalesce("source_text", F.lit("")) == ""), "empty-quote", F.col("id"))
    return none.unionByName(blank).unionByName(_issue(quotes.where(~F.coalesce("verified", F.lit(False))), "unverified-quote", F.col("id"), "warning"))


def relationships(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """L3: what speaks against an edge; a self-loop is a warning."""
    bad = validate_edges(edges, nodes).where("reason is not null")
    loops = edges.where("from_id = to_id")
    return bad.select("document_id", F.concat(F.lit("edge-"), "reason").alias("code"), F.lit("error").alias("severity"), F.col("ord").cast("string").alias("entity_id")).unionByName(_issue(loops, "edge-self-loop", F.col("ord"), "warning"))


def references(keys: DataFrame, index: DataFrame) -> DataFrame:
    """L4: foreign keys ``(document_id, id, column, target, wanted_type)`` without an entity, or with one of another type."""
    x = keys.where("target is not null").join(index.select("document_id", F.col("id").alias("target"), "entity_type"), ["document_id", "target"], "left")
    code = F.when(F.col("entity_type").isNull(), "dangling-reference").when(F.col("entity_type") != F.col("wanted_type"), "wrong-reference-type")
    return x.withColumn("code", code).where("code is not null").select("document_id", "code", F.lit("error").alias("severity"), F.col("id").cast("string").alias("entity_id"))


def foreign_keys(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """L4: ``(table, column, wanted type)`` as one tall table."""
    return reduce(DataFrame.unionByName, [t.select("document_id", "id", F.lit(c).alias("column"), F.col(c).alias("target"), F.lit(kind).alias("wanted_type")) for t, c, kind in tables])


def duplicates(index: DataFrame) -> DataFrame:
    """Ids that occur more than once."""
    return _issue(index.groupBy("document_id", "id").agg(F.count("*").alias("n")).where("n > 1"), "duplicate-id", F.col("id"))


def sizes(table: DataFrame, collection: str, most: int = 800) -> DataFrame:
    """Documents with too many entities of a kind."""
    return _issue(table.groupBy("document_id").agg(F.count("*").alias("n")).where(F.col("n") > most), "too-many-entities", F.lit(collection))


def pages(table: DataFrame, content: DataFrame) -> DataFrame:
    """Pages that the document does not have."""
    return _issue(table.join(content.select("document_id", "page_count"), "document_id").where(~F.col("page").between(1, F.col("page_count"))), "page-out-of-range", F.col("id"))


def report(issues: list[DataFrame], most: int = 500) -> DataFrame:
    """All issues, at most ``most`` a document, errors first."""
    every = reduce(DataFrame.unionByName, [i.select(ISSUE) for i in issues])
    w = Window.partitionBy("document_id").orderBy(F.col("severity") != "error", "code", "entity_id")
    return every.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def summary(issues: DataFrame, documents: DataFrame) -> DataFrame:
    """Errors and warnings of each document; valid without errors."""
    n = issues.groupBy("document_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return documents.select("document_id").distinct().join(n, "document_id", "left").na.fill(0).withColumn("valid", F.col("errors") == 0)
