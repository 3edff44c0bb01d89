"""Operators on small inline tables."""

from datetime import date

from pyspark.sql import functions as F

from lexspark.functions import text as T
from lexspark.operators import ask as A
from lexspark.operators import clauses as C
from lexspark.operators import compare as M
from lexspark.operators import consistency as I
from lexspark.operators import deadlines as D
from lexspark.operators import drafts as X
from lexspark.operators import graph as R
from lexspark.operators import risk as K
from lexspark.operators import views as U


def values(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def test_segment_with_preamble(spark):
    text = "Between A and B\n1. PAYMENT\n1.1 The Customer shall pay.\n(a) at once\nSCHEDULE A\nlast"
    got = C.segment(spark.createDataFrame([(1, text), (2, "")], "document_id long, text string"))
    assert values(got.select("ord", "number", "heading", "level"), "ord")[:4] == [(1, None, "Preamble", 0), (2, "1", "PAYMENT", 1), (3, "1.1", "The Customer shall pay.", 2), (4, "a", "at once", 3)]
    assert got.where("document_id = 2").count() == 0


def test_periods(spark):
    got = one(spark, T.periods(F.lit("within thirty (30) days, seventeen weeks or 2 business days; not 5dayz")))
    assert [(p["amount"], p["unit"], p["n_days"]) for p in got] == [(30, "day", 30), (17, "week", 119), (2, "day", 2)]


def test_status_truth_table(spark):
    day = F.lit("2026-01-01").cast("date")
    case = lambda *a: one(spark, D.status(*[F.lit(x) for x in a[:2]], F.lit(a[2]).cast("date"), day))
    assert case(True, False, "2020-01-01") == "informational"
    assert case(False, True, None) == "conditional"
    assert case(False, False, None) == "unknown"
    assert [case(False, False, d) for d in ("2025-12-31", "2026-01-01", "2026-01-31", "2026-02-01")] == ["overdue", "due", "due", "upcoming"]


def test_recurrence_and_month_ends(spark):
    day = F.lit("2026-03-15").cast("date")
    nxt = lambda a, r: one(spark, D.next_occurrence(F.lit(a).cast("date"), F.lit(r), day))
    assert nxt("2026-01-31", "monthly") == date(2026, 4, 3)  # by way of 3 March, which the day before ran on to
    assert nxt("2025-03-15", "annually") == date(2026, 3, 15)
    assert nxt("2025-09-15", "Semi-Annually") == date(2026, 3, 15)
    assert nxt("2020-01-01", "daily") == date(2021, 2, 4)  # 400 steps
    assert nxt("2020-01-01", "fortnightly") is None
    assert nxt("2026-03-01", "weekly") == date(2026, 3, 15)
    assert one(spark, D.add_period(F.lit("2026-01-31").cast("date"), F.lit(1), F.lit("month"))) == date(2026, 3, 3)
    assert one(spark, D.add_period(F.lit("2024-02-29").cast("date"), F.lit(1), F.lit("year"))) == date(2025, 3, 1)


def test_notice_conflict_reads_only_near_notice_words(spark):
    rows = [(1, "a", 1, "TERM", "Either may terminate on 30 days notice."), (1, "b", 2, "TERM", "It may terminate on ninety days written notice."), (1, "c", 3, "FEES", "Pay in 5 days. " + "x" * 70 + " notice of termination"), (2, "d", 1, None, None)]
    c = spark.createDataFrame(rows, "document_id long, clause_id string, ord int, heading string, text string")
    assert values(I.conflicting_notice(c).select("document_id", "clause_id", "entity_id", "title")) == [(1, "a", "b", "Notice of termination: 30 or 90 days")]


def test_paths_cycles_reach(spark):
    edges = spark.createDataFrame([(1, "t", "a", "b"), (1, "t", "b", "c"), (1, "t", "c", "a"), (1, "t", "c", "d"), (2, "t", "x", "y")], "document_id long, type string, from_id string, to_id string")
    start = spark.createDataFrame([(1, "a")], "document_id long, id string")
    assert values(R.reach(edges, start, 3, directed=True).select("id", "depth"), "id") == [("a", 0), ("b", 1), ("c", 2), ("d", 3)]
    assert values(R.cycles(edges).select("document_id", "path")) == [(1, ["a", "b", "c", "a"])]
    pairs = spark.createDataFrame([(1, "a", "d"), (1, "a", "z")], "document_id long, a string, b string")
    assert values(R.shortest_paths(edges, pairs).select("b", "path"), "b") == [("d", ["a", "c", "d"]), ("z", None)]


def test_word_diff():
    assert M.diff_words("pay in 5 days", "pay in ten days now") == [("equal", "pay in"), ("removed", "5"), ("added", "ten"), ("equal", "days"), ("added", "now")]
    assert M.diff_words("", None) == []
    assert M.diff_words("a " * 3, "b", most=2) == [("removed", "a a a"), ("added", "b")]


def test_drafts_survive_bad_replies(spark):
    replies = [(1, 0, '```json\n{"parties": [{"name": " Acme ", "aliases": ["A"]}, {"role": "x"},]}\n```'), (2, 0, "sorry"), (3, 0, None), (4, 0, '{"parties": "none"}')]
    parsed = X.parse(spark.createDataFrame(replies, "document_id long, chunk int, reply string"))
    assert values(parsed.select("document_id", "parse_status"), "document_id") == [(1, "repaired"), (2, "failed"), (3, "failed"), (4, "ok")]
    assert values(X.drafts(parsed, "parties").select("document_id", "pos", "name", "aliases")) == [(1, 0, "Acme", ["A"])]


def test_provider_errors_are_rows(spark):
    prompts = spark.createDataFrame([(1, "has one"), (2, "other")], "document_id long, prompt string")
    got = values(X.call(prompts, X.fixture_provider({"one": "{}"})).select("document_id", "reply", "error"), "document_id")
    assert got[0] == (1, "{}", None) and got[1][1] is None and "LookupError" in got[1][2]


def test_merge_intervals(spark):
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 1, 2)], "document_id long, start_offset int, end_offset int")
    assert values(U.merge_intervals(spans, ["document_id"]), "start_offset") == [(1, 0, 7), (1, 9, 10)]


def test_streaming_arrivals_import():
    from lexspark.streaming import arrivals

    assert arrivals.__doc__


def test_duties_by_trigger_standard_and_effective_date(spark):
    """What the truth table of the reference says: a trigger needs a condition, an effective date is an anchor, recurrence needs its type."""
    as_of = F.lit("2026-01-01").cast("date")
    deadlines = spark.createDataFrame(
        [(1, "r", None, "recurring", None, None, "monthly", None), (1, "n", None, "relative", None, None, "monthly", None), (1, "o", None, "relative", 10, "day", None, None), (2, "o", None, "relative", 10, "day", None, None), (1, "f", date(2026, 1, 31), "fixed", 10, "day", None, None)],
        "document_id long, id string, date date, date_type string, offset_amount int, offset_unit string, recurrence string, anchor_date date",
    )
    effective = spark.createDataFrame([(1, date(2025, 12, 20))], "document_id long, effective_date date")
    got = values(D.resolve(deadlines, as_of, effective).select("document_id", "id", "resolved_date", "reason"), "document_id", "id")
    assert got == [(1, "f", date(2026, 1, 31), None), (1, "n", None, "no-date-stated"), (1, "o", date(2025, 12, 30), None), (1, "r", date(2026, 1, 20), None), (2, "o", None, "no-anchor-date")]
    duties = spark.createDataFrame(
        [(1, "a", "o", None, None, None, False), (2, "b", "o", "k", None, None, False), (2, "c", "o", None, "on delivery", None, False), (2, "d", None, None, "on delivery", None, False), (1, "e", "f", None, None, "informational", False), (1, "g", "gone", "k", None, None, False)],
        "document_id long, id string, deadline_id string, trigger_condition_id string, trigger_text string, standard string, informational boolean",
    )
    assert values(D.assess(duties, deadlines, as_of, effective).select("id", "status", "days_left"), "id") == [("a", "overdue", -2), ("b", "conditional", None), ("c", "unknown", None), ("d", "unknown", None), ("e", "informational", None), ("g", "conditional", None)]


def test_edge_words(spark):
    rows = spark.createDataFrame([("clause-references",), ("condition-triggers",), ("document-has-party",), ("made-up-type",)], "t string").select("t", R.semantics(F.col("t")), R.label(F.col("t")))
    assert values(rows, "t") == [("clause-references", "reference", "references clause"), ("condition-triggers", "time", "triggers"), ("document-has-party", "structure", "has party"), ("made-up-type", "reference", "made up type")]


def test_confidence(spark):
    level = lambda *a: one(spark, A.confidence(*[F.lit(x) for x in a]))  # noqa: E731  top score, verified, failed, cited, injected
    assert [level(9, 2, 0, 2, False), level(9, 1, 1, 2, False), level(9, 1, 0, 2, False), level(5, 2, 0, 2, False), level(1, 0, 1, 1, True), level(1, 0, 1, 1, False), level(1, 0, 0, 1, False)] == ["high", "low", "medium", "medium", "none", "none", "low"]


def test_termination_wording(spark):
    says = lambda text: one(spark, T.matches(F.lit(text), K.PATTERNS["termination-act"]))
    assert [says(t) for t in ("The Buyer shall be entitled to terminate", "The Buyer may suspend", "a right to terminate", "shall terminate", "is entitled to terminate", "right to suspend", "may lawfully terminate")] == [True, True, True, False, False, False, False]


def test_findings_of_an_entity_count_once(spark):
    found = spark.createDataFrame([(1, "f1", "c1", "c2"), (1, "f2", None, "o1"), (2, "f3", "c1", None), (1, "f4", None, None)], "document_id long, finding_id string, clause_id string, entity_id string")
    wanted = spark.createDataFrame([(1, "o1", ["c1", "c2"]), (1, "o2", None), (2, "o3", [])], "document_id long, id string, clause_ids array<string>")
    assert values(I.of_entities(found, wanted).select("document_id", "id", "finding_id"), "finding_id") == [(1, "o1", "f1"), (1, "o1", "f2")]


def test_citations_of_a_clause(spark):
    clauses = spark.createDataFrame([(1, "c1"), (1, "c2")], "document_id long, clause_id string")
    facts = spark.createDataFrame([(1, "o1", "c1"), (1, "o2", None)], "document_id long, id string, clause_id string")
    quotes = [(1, "o1", "c2", "q", 3, "b"), (1, "o2", "c2", "q", 3, "a"), (1, "c1", "c1", "own", None, "z"), (1, "gone", "c1", "lost", None, "y")]
    evidence = spark.createDataFrame(quotes, "document_id long, entity_id string, clause_id string, source_text string, start_offset int, id string")
    assert values(M.clause_citations(clauses, facts, evidence).select("of_clause", "source_text", "id"), "of_clause", "id") == [("c1", "q", "b"), ("c1", "own", "z"), ("c2", "q", "a")]


def test_provider_choice_and_checks(spark):
    mock, far = (lambda p: "m"), (lambda p: "f")
    assert X.choose_provider({}, {"mock": mock}) is mock
    assert X.choose_provider({"provider": "FAR"}, {"mock": mock, "far": far}) is far
    assert X.choose_provider({"provider": "nowhere"}, {"mock": mock, "far": far}) is mock
    assert [X.ready({}), X.ready({"provider": "far"}), X.ready({"provider": "far", "url": "https://x"})] == [True, False, True]
    replies = spark.createDataFrame([(1, "{}", None), (2, " \n", None), (3, None, "Timeout: x"), (4, None, None)], "document_id long, reply string, error string")
    assert values(X.checked(replies), "document_id") == [(1, "{}", None), (2, None, X.EMPTY_REPLY), (3, None, "Timeout: x"), (4, None, X.NO_TEXT)]
    asked = one(spark, X.prompt_problems(F.lit(None).cast("string"), F.lit(" ")))
    assert asked == [X.NO_SYSTEM, X.NO_USER]
