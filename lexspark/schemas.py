"""Tables of the contract model: columns, vocabularies and the edge schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Entity types and the id prefix of each.
ID_PREFIX = {
    "document": "doc", "party": "party", "clause": "cl", "definition": "def", "right": "right", "obligation": "obl",
    "condition": "cond", "deadline": "dl", "consequence": "cons", "risk": "risk", "inconsistency": "inc",
    "evidence": "ev", "relationship": "rel",
}
MODEL_TYPES = ["document", "party", "clause", "definition", "right", "obligation", "condition", "deadline", "consequence", "risk", "inconsistency"]

# Relationship types with the entity types that each may join.
EDGE_TYPES: dict[str, tuple[list[str], list[str]]] = {
    "document-has-party": (["document"], ["party"]),
    "document-has-clause": (["document"], ["clause"]),
    "clause-references": (["clause"], ["clause"]),
    "clause-defines": (["clause"], ["definition"]),
    "clause-imposes-obligation": (["clause"], ["obligation"]),
    "clause-grants-right": (["clause"], ["right"]),
    "clause-states-condition": (["clause"], ["condition"]),
    "clause-sets-deadline": (["clause"], ["deadline"]),
    "clause-states-consequence": (["clause"], ["consequence"]),
    "clause-flags-risk": (["clause"], ["risk"]),
    "party-obligated-by": (["party"], ["obligation"]),
    "obligation-owed-to": (["obligation"], ["party"]),
    "party-holds-right": (["party"], ["right"]),
    "right-held-against": (["right"], ["party"]),
    "obligation-triggered-by": (["obligation"], ["condition"]),
    "obligation-has-deadline": (["obligation"], ["deadline"]),
    "obligation-results-in": (["obligation"], ["consequence"]),
    "condition-triggers": (["condition"], ["obligation", "consequence", "condition"]),
    "condition-has-deadline": (["condition"], ["deadline"]),
    "consequence-follows-condition": (["consequence"], ["condition"]),
    "consequence-affected-party": (["consequence"], ["party"]),
    "definition-applies-to": (["definition"], ["clause", "obligation", "right", "condition", "deadline", "consequence"]),
    "deadline-anchored-to": (["deadline"], ["obligation", "condition", "clause"]),
    "risk-about": (["risk"], MODEL_TYPES),
    "inconsistency-between": (["inconsistency"], MODEL_TYPES),
    "entity-relates-to": (MODEL_TYPES, MODEL_TYPES),
}

# Severities from the gravest, and the days of a period unit with whether they are exact.
SEVERITIES = ["critical", "high", "medium", "low", "info", "unknown"]
UNIT_DAYS = {"day": (1, True), "week": (7, True), "month": (30, False), "year": (365, False)}
# Months or days of a named recurrence.
RECURRENCES = {"daily": (1, "day"), "weekly": (7, "day"), "monthly": (1, "month"), "quarterly": (3, "month"), "annually": (12, "month"), "semi-annually": (6, "month")}

_BASE = "document_id bigint, id string"
TABLES = {
    "clauses": f"{_BASE}, ord int, number string, heading string, text string, level int, clause_type string, parent_clause_id string, start_offset int, end_offset int, page int",
    "parties": f"{_BASE}, name string, role string, aliases array<string>",
    "definitions": f"{_BASE}, term string, text string, clause_id string",
    "rights": f"{_BASE}, summary string, holder_party_id string, counterparty_party_id string, clause_id string",
    "obligations": f"{_BASE}, ord int, summary string, obligor_party_id string, obligee_party_id string, clause_id string, standard string, trigger_condition_id string, trigger_text string, deadline_id string, consequence_ids array<string>, consequence_text string, informational boolean",
    "conditions": f"{_BASE}, condition_type string, trigger_description string, clause_id string, deadline_id string",
    "deadlines": f"{_BASE}, description string, date date, date_type string, event string, anchor_event string, anchor_date date, offset_amount int, offset_unit string, recurrence string, clause_id string",
    "consequences": f"{_BASE}, description string, severity string, clause_id string, trigger_condition_id string, affected_party_id string",
    "evidence": f"{_BASE}, entity_id string, entity_type string, clause_id string, page int, source_text string, start_offset int, end_offset int",
    "relationships": f"{_BASE}, type string, from_id string, from_type string, to_id string, to_type string, directed boolean",
}


def empty(spark: SparkSession, table: str) -> DataFrame:
    """A table of the model without rows."""
    return spark.createDataFrame([], TABLES[table])


def edge_schema(spark: SparkSession) -> DataFrame:
    """``(type, from_type, to_type)``, one row for each allowed combination; a few hundred rows."""
    rows = [(t, a, b) for t, (starts, ends) in EDGE_TYPES.items() for a in starts for b in ends]
    return spark.createDataFrame(rows, "type string, from_type string, to_type string")
