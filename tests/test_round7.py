"""Findings of round 4: what was left out, and what steps deal out, on small tables."""

import re

from pyspark.sql import functions as F

from lexspark import shared
from lexspark.operators import deadlines as D
from lexspark.operators import graph as R
from lexspark.operators import risk as K
from lexspark.plans import REGISTRY
from lexspark.plans.model import as_of, model

SF = "/root/testdata/sf0.001"


def test_checklist_has_all_kinds(spark):
    """inconsistencies and facts without a verified quote are items as well."""
    kinds = {r["kind"]: r["count"] for r in REGISTRY["checklist"].run(spark, SF).groupBy("kind").count().collect()}
    assert kinds["inconsistency"] == REGISTRY["inconsistency_findings"].run(spark, SF).count()
    assert kinds["evidence"] == REGISTRY["evidence_coverage"].run(spark, SF).where("verified < facts").count()
    assert {"overdue", "risk", "undated-duty", "undated-deadline"} <= kinds.keys()


def test_plan_counts_what_changes_reach(spark):
    """a change tells how many entities hang off its clause, and not none for all."""
    said = {r["text"]: r["count"] for r in REGISTRY["prep_plan"].run(spark, SF).where("kind = 'changes'").groupBy("text").count().collect()}
    near = {n for n in range(9) if any(text.endswith(f" {n}") for text in said)}
    assert near == {1, 2, 3}
    assert {text.rsplit(" ", 1)[0] for text in said} == {"clause modified", "clause removed"}


def test_signals_of_dealt_tables(spark):
    """Of a dealt model the rules read one exchange and deal nothing out again, and find what they find in any tables."""
    m, plain = model(spark, SF, dealt=True), model(spark, SF)
    tables = lambda x: (x.clauses, x.obligations, x.deadlines, x.conditions, x.rights, x.parties, as_of())
    found = K.signals(*tables(m), dealt=True)
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(found) == rows(K.signals(*tables(plain)))
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "rule_id, " not in "".join(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    # Read at the first run: the lines are numbered and dealt out once, whatever the number of tables.
    assert plan.count("REPARTITION_BY_NUM") - plan.count("ReusedExchange") <= 3
    duties = D.assess(m.obligations, m.deadlines, as_of(), dealt=True)
    assert rows(duties) == rows(D.assess(plain.obligations, plain.deadlines, as_of()).select(duties.columns))


def test_rules_meet_by_windows_as_by_joins(spark):
    """Missing keys meet nothing, repeats meet each; a deadline without a clause is read by itself."""
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    clauses = table([(1, "a", None, "Notice of 5 days."), (1, "a", None, "Notice of 3 days."), (1, None, "Renewal", "Notice of 1 day."), (None, "a", "Renewal", "Notice of 1 day."), (2, "b", "Renewal", "x"), (2, "c", "Renewal", "x"), (2, "d", "Renewal", "x")], "document_id long, clause_id string, heading string, text string")
    deadlines = table([(1, "d1", "a", "within"), (1, "d2", None, "Notice: 9 days"), (None, "d3", "a", "Notice: 8 days"), (1, "d4", "z", "Notice: 40 days"), (2, "d5", "b", "x")], "document_id long, id string, clause_id string, description string").withColumn("event", F.lit(None).cast("string")).withColumn("anchor_event", F.lit(None).cast("string"))
    found = sorted((r["entity_id"], r["title"]) for r in K.short_notice(deadlines, clauses).collect())
    assert found == [("d1", "Notice period of 3 days"), ("d2", "Notice period of 9 days"), ("d3", "Notice period of 8 days")]
    conditions = table([(2, "k", "c", "notice"), (2, "l", "d", "breach")], "document_id long, id string, clause_id string, condition_type string")
    typed = clauses.withColumn("clause_type", F.lit("other")).withColumn("number", F.lit("1"))
    assert sorted((r["document_id"] or 0, r["clause_id"] or "") for r in K.renewal_without_window(typed, deadlines, conditions).collect()) == [(0, "a"), (1, ""), (2, "d")]


def test_without_keeps_what_an_anti_join_keeps(spark):
    """null keys and repeats stay, with and without a join."""
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", None), (1, None, "y"), (None, "a", "z"), (2, "a", "w")], "document_id long, id string, said string")
    others = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (1, None), (2, "b")], "document_id long, id string")
    kept = lambda dealt: sorted(map(tuple, shared.without(rows.repartition(8, "document_id"), others.repartition(8, "document_id"), ["document_id", "id"], dealt).collect()), key=repr)
    assert kept(True) == kept(False) == sorted([(1, "b", None), (1, None, "y"), (None, "a", "z"), (2, "a", "w")], key=repr)


def test_inconsistencies_are_dealt_out_as_findings_only(spark):
    """the rules over a dealt model deal out no clauses, numbers or ids of entities again."""
    plan = REGISTRY["inconsistency_findings"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\(document_id#\d+L?, (known|top|id|clause_id)#", plan)


def test_node_rows_lie_where_their_lines_do(spark):
    """over a dealt model nodes and ends meet where they lie."""
    plan = REGISTRY["node_rows"].run(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"hashpartitioning\((deal#\d+L?, )?document_id#\d+L?, (other_id|id)#", plan)


def test_rows_of_odd_nodes_and_edges(spark):
    """ends that are no node, open ends, repeats and nodes without edges."""
    nodes = spark.createDataFrame([(1, "a", "right", "A"), (1, "b", "party", "B"), (1, "b", "clause", "C"), (1, None, "party", "N"), (2, "a", "clause", "Z")], "document_id long, id string, entity_type string, label string")
    edges = spark.createDataFrame([(1, "party-holds-right", "b", "a"), (1, "x-y", "a", "lost"), (1, "x-y", None, "a")], "document_id long, type string, from_id string, to_id string")
    got = sorted((r["document_id"], r["id"] or "", r["label"], [(k["phrase"], k["other_id"], k["other_label"], k["other_type_label"]) for k in r["links"]]) for r in R.rows(nodes, edges).collect())
    held = [("holds right (incoming)", "b", "B", "Party"), ("holds right (incoming)", "b", "C", "Clause"), ("x y", "lost", "lost", "Entity"), ("x y (incoming)", None, None, "Entity")]
    assert got == [(1, "", "N", []), (1, "a", "A", held), (1, "b", "B", [("holds right", "a", "A", "Right")]), (1, "b", "C", [("holds right", "a", "A", "Right")]), (2, "a", "Z", [])]


def test_meet_is_a_join(spark):
    """by windows as by joins, repeats, null keys and rows without a match included."""
    rows = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "b", None), (1, None, "y"), (None, "a", "z")], "document_id long, id string, said string").repartition(8, "document_id")
    others = spark.createDataFrame([(1, "a", 1), (1, "a", 2), (None, "a", 3), (1, None, 4), (2, "b", 5)], "document_id long, id string, n int").repartition(8, "document_id")
    got = lambda how, dealt: sorted(map(tuple, shared.meet(rows, others, ["document_id", "id"], how, dealt).collect()), key=repr)
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert got(how, True) == got(how, False)


def test_laid_tables_are_dealt_out_once(spark):
    """steps of one job that read a laid table several times read one exchange, whatever they leave out."""
    (table,) = shared.written_tables("test", spark.range(40).selectExpr("id div 4 as document_id", "id", "id * 2 as twice"))
    laid = shared.lay(table)
    both = laid.where("document_id is not null").select("document_id", "id").unionByName(laid.where("twice > 9").select("document_id", F.col("twice").alias("id")))
    out = both.groupBy("document_id", "id").count()
    assert len(out.collect()) == 75
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("ReusedExchange") == 1 and "ENSURE_REQUIREMENTS" not in plan
