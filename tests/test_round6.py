"""Steps of round 3's findings that do less for each row, on small tables."""

from pyspark.sql import functions as F

from lexspark.functions.text import comparable
from lexspark.operators import compare as M


def test_plain_texts_only_change_their_case(spark):
    """Of plain ASCII texts the comparison form takes one look, and gives what it gave."""
    forms = {"Acme Ltd.": "acme ltd.", " A": "a", "A ": "a", "a  b": "a b", "a\tb": "a b", "‘A’": "'a'", "É": "é", "a\n": "a", "a\x07B": "ab", "": "", None: ""}
    rows = spark.createDataFrame([(t,) for t in forms], "t string").select("t", comparable(F.col("t")).alias("c"))
    assert {r["t"]: r["c"] for r in rows.collect()} == forms
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan and "ELSE coalesce(lower(t" in plan


def test_links_are_hashed_and_not_sorted(spark):
    """of equal links the first table's name counts, told by a number, so that no task sorts all links; each table is read once for both ends."""
    one = spark.createDataFrame([(1, "a", "b"), (1, "c", "c"), (1, None, "d")], "document_id long, x string, y string")
    two = spark.createDataFrame([(1, "b", "a"), (1, "b", "e")], "document_id long, x string, y string")
    made = M.links([(one, "x", "y", "z-first"), (two, "x", "y", "a-second")])
    plan = made._jdf.queryExecution().executedPlan().toString()
    rows = {(r["node"], r["neighbour"], r["via"]) for r in made.collect()}
    assert made.count() == len(rows) and rows == {("a", "b", "z-first"), ("b", "a", "z-first"), ("b", "e", "a-second"), ("e", "b", "a-second")}
    assert "SortAggregate" not in plan and plan.count("Scan ExistingRDD") == 2
