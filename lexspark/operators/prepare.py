"""Review preparation: checklist, questions and plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import cut, severity_rank
from ..shared import by_document

SECTIONS = ["questions", "facts", "clauses", "changes"]
ITEM = ["document_id", "kind", "severity", "item_id", "text"]


def item(rows: DataFrame, kind: str, severity: str | Column, ident: Column, text: Column) -> DataFrame:
    return rows.select("document_id", F.lit(kind).alias("kind"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), ident.cast("string").alias("item_id"), text.alias("text"))


def checklist(assessed: DataFrame, risks: DataFrame, inconsistencies: DataFrame | None, coverage: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """What to look at before signing, the gravest first, then in the order of the kinds. Of ``dealt`` tables nothing is dealt out again."""
    duty = lambda s: assessed.where(F.col("status").isin(s) if isinstance(s, list) else F.col("status") == s)
    words = lambda lead: F.concat(F.lit(lead), cut(F.col("summary"), 80))
    parts = [
        item(duty("overdue"), "overdue", "high", F.col("id"), words("Overdue: ")),
        item(duty("due"), "due", "medium", F.col("id"), words("Due soon: ")),
        item(duty("unknown").where("deadline_found"), "undated-deadline", "medium", F.col("id"), words("Deadline without date: ")),
        item(duty("unknown").where("not deadline_found"), "undated-duty", "medium", F.col("id"), words("Duty without timing: ")),
        item(risks.where(severity_rank(F.col("severity")) <= 2), "risk", F.col("severity"), F.col("finding_id"), F.col("title")),
    ]
    if inconsistencies is not None:
        parts.append(item(inconsistencies, "inconsistency", F.col("severity"), F.col("finding_id"), F.col("title")))
    if coverage is not None:
        parts.append(item(coverage.where("verified < facts"), "evidence", "low", F.lit("evidence"), F.concat(F.lit("Facts without verified quote: "), (F.col("facts") - F.col("verified")).cast("string"))))
    every = by_document(reduce(DataFrame.unionByName, parts), dealt)
    kinds = F.array(*[F.lit(k) for k in ("overdue", "due", "undated-deadline", "undated-duty", "risk", "inconsistency", "evidence")])
    w = Window.partitionBy("deal", "document_id").orderBy(severity_rank(F.col("severity")), F.array_position(kinds, F.col("kind")), "item_id")
    return every.withColumn("place", F.row_number().over(w)).drop("deal")


def as_text(items: DataFrame) -> DataFrame:
    """A checklist as lines of text."""
    line = F.concat(F.lit("[ ] "), F.col("severity"), F.lit(": "), F.col("text"))
    return items.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n").alias("text"))


def questions(assessed: DataFrame, risks: DataFrame) -> DataFrame:
    """What to ask: duties without timing or without a party, and graver risks."""
    parts = [
        item(assessed.where("status = 'unknown'"), "questions", "medium", F.concat(F.lit("timing:"), "id"), F.concat(F.lit("When is due: "), cut(F.col("summary"), 80))),
        item(assessed.where("obligor_party_id is null"), "questions", "high", F.concat(F.lit("party:"), "id"), F.concat(F.lit("Who owes: "), cut(F.col("summary"), 80))),
        item(risks.where(severity_rank(F.col("severity")) <= 2), "questions", F.col("severity"), F.concat(F.lit("risk:"), "finding_id"), F.concat(F.lit("Is this meant: "), F.col("title"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def facts(parties: DataFrame, assessed: DataFrame, definitions: DataFrame | None = None) -> DataFrame:
    """What to confirm: the parties, duties that no one owes, deadlines without a date, empty definitions."""
    parts = [
        item(parties, "facts", "info", F.concat(F.lit("party:"), "id"), F.concat(F.lit("Party: "), F.col("name"))),
        item(assessed.where("obligor_party_id is null"), "facts", "medium", F.concat(F.lit("open:"), "id"), F.lit("Duty without party")),
        item(assessed.where("status = 'unknown' and deadline_found"), "facts", "medium", F.concat(F.lit("date:"), "id"), F.lit("Deadline without date")),
    ]
    if definitions is not None:
        parts.append(item(definitions.where(F.coalesce("text", F.lit("")) == ""), "facts", "medium", F.concat(F.lit("term:"), "id"), F.concat(F.lit("Empty definition: "), F.col("term"))))
    return reduce(DataFrame.unionByName, parts)


def clauses_to_read(findings: DataFrame) -> DataFrame:
    """P5: clauses with findings: the gravest severity, and the rules, each once in the order of the findings."""
    first = findings.where("clause_id is not null").groupBy("document_id", "clause_id", "rule_id").agg(F.min("place").alias("place"), F.min(F.struct(severity_rank(F.col("severity")).alias("r"), "severity")).alias("s"))
    rows = first.groupBy("document_id", "clause_id").agg(F.min("s")["severity"].alias("severity"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "rule_id"))), lambda x: x["rule_id"]), ", ").alias("reasons"))
    return item(rows, "clauses", F.col("severity"), F.col("clause_id"), F.col("reasons"))


def changes_to_read(changes: DataFrame, reached: DataFrame) -> DataFrame:
    """Changes ``(document_id, id, scope, change)`` with how many entities are one link away, by ``reached(document_id, source, id, distance)``."""
    near = reached.where("distance = 1").groupBy("document_id", F.col("source").alias("id")).agg(F.count("*").alias("near"))
    rows = changes.where("change <> 'unchanged'").join(near, ["document_id", "id"], "left")
    return item(rows, "changes", "medium", F.col("id"), F.concat_ws(" ", "scope", "change", F.coalesce(F.col("near"), F.lit(0)).cast("string")))


def plan(sections: list[DataFrame], per_section: int = 12) -> DataFrame:
    """Items by section, each id once, the gravest first, at most ``per_section``. They are dealt out once, by document."""
    every = by_document(reduce(DataFrame.unionByName, [s.select(ITEM) for s in sections]))
    once = Window.partitionBy("deal", "document_id", "kind", "item_id").orderBy(severity_rank(F.col("severity")), "text")
    first = every.withColumn("r", F.row_number().over(once)).where("r = 1").drop("r")
    w = Window.partitionBy("deal", "document_id", "kind").orderBy(severity_rank(F.col("severity")), "item_id")
    return first.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_section).drop("deal")


def plan_counts(planned: DataFrame) -> DataFrame:
    """Items of each section, zeros included."""
    grid = planned.select("document_id").distinct().withColumn("kind", F.explode(F.array(*[F.lit(s) for s in SECTIONS])))
    n = planned.groupBy("document_id", "kind").agg(F.count("*").alias("n"))
    return grid.join(n, ["document_id", "kind"], "left").na.fill(0, ["n"])
