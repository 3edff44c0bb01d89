"""Sweeps over offsets, the graph view, paths and the stage tracker on small tables."""

import random
from datetime import datetime

from lexspark.operators import clauses as C
from lexspark.operators import dictionary as N
from lexspark.operators import evidence as V
from lexspark.operators import graph as R
from lexspark.operators import sweeps as W
from lexspark.operators import views as U
from lexspark.streaming import tracker as T


def test_overlaps_and_innermost_by_all_pairs(spark):
    """Nested, crossing, touching, equal, empty and reversed intervals over several documents and batches."""
    rng = random.Random(3)
    spans = [(d, f"{d}-{i}", i, *sorted((rng.randint(0, 60), rng.randint(0, 60)))) for d in range(4) for i in range(30)] + [(1, "r", 99, 9, 3), (None, "n", 1, 0, 9)]
    asked = [(d, i, lo, lo + rng.randint(0, 12)) for d in range(5) for i, lo in enumerate(rng.randint(0, 60) for _ in range(20))]
    left = spark.createDataFrame(asked, "document_id long, ask int, lo int, hi int")
    right = spark.createDataFrame(spans, "document_id long, clause_id string, ord int, start_offset int, end_offset int")
    pairs = W.overlaps(left, right.selectExpr("document_id", "clause_id", "start_offset lo", "end_offset hi"), "ask", "clause_id").collect()
    assert sorted(map(tuple, pairs)) == sorted((d, i, c) for d, i, lo, hi in asked for e, c, _, a, b in spans if d == e and a <= b and lo <= b and hi >= a)
    points = [(d, o) for d in range(5) for o in range(0, 64, 3)]
    got = {(r[0], r[1]): r[2] for r in C.innermost_clause(spark.createDataFrame(points, "document_id long, offset int"), right).select("document_id", "offset", "clause_id").collect()}
    for d, o in points:
        around = [(b - a, n, c) for e, c, n, a, b in spans if e == d and a <= o < b]
        assert got[d, o] == (min(around)[2] if around else None)


def test_overlaps_of_tables_dealt_by_document(spark):
    """tables that are dealt by document already, of sizes that are merged into partitions unlike: the sides still meet."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window

    w = Window.partitionBy("document_id").orderBy("i")
    many = spark.range(120_000).selectExpr("id % 40000 document_id", "id i").withColumn("n", F.row_number().over(w))
    few = spark.range(40_000).selectExpr("id document_id", "id i").withColumn("n", F.row_number().over(w))
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "300k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "48"}
    was = {k: spark.conf.get(k) for k in sizes}
    for k, v in sizes.items():
        spark.conf.set(k, v)
    try:
        pairs = W.overlaps(many.selectExpr("document_id", "i", "n lo", "n hi"), few.selectExpr("document_id", "concat('r', n) r", "n lo", "n + 1 hi"), "i", "r")
        assert pairs.count() == 80_000
        # What counts at larger sizes: the order is asked for by the node below the function, and not only given to it.
        assert "RepartitionByExpression" not in pairs._jdf.queryExecution().analyzed().toString() and "row_number" in pairs._jdf.queryExecution().optimizedPlan().toString().split("MapInPandas")[1].split("Union")[0]
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_cycles_of_many_documents_come_in_batches(spark):
    """one call of the walk a batch, not one a document; each document's cycles for itself, repeated edges once."""
    edges = spark.range(4000).selectExpr("id document_id", "explode(array(struct('a' f, 'b' t), struct('b' f, 'a' t), struct('a' f, 'b' t), struct('b' f, 'b' t))) e").selectExpr("document_id", "e.f from_id", "e.t to_id")
    found = R.cycles(edges)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    rows = found.collect()
    assert len(rows) == 8000 and {(r["cycle"], tuple(r["path"])) for r in rows} == {(0, ("a", "b", "a")), (1, ("b", "b"))}


def test_last_before(spark):
    starts = spark.createDataFrame([(1, 0, 1), (1, 10, 2), (1, 10, 3), (2, 5, 9)], "document_id long, at int, page int")
    points = spark.createDataFrame([(1, 0), (1, 9), (1, 10), (1, 99), (1, 99), (2, 4), (2, 5), (3, 1)], "document_id long, offset int")
    assert sorted(map(tuple, W.last_before(points, starts, "at", ["page"]).collect())) == [(1, 0, 1), (1, 9, 1), (1, 10, 3), (1, 99, 3), (2, 5, 9)]


def test_segments_by_characters(spark):
    """Each part is marked or not as its characters are, and the parts make up the blocks."""
    rng = random.Random(5)
    marks = [(d, *sorted(rng.sample(range(100), 2))) for d in range(3) for _ in range(6)]
    merged = U.merge_intervals(spark.createDataFrame(marks, "document_id long, start_offset int, end_offset int"), ["document_id"])
    blocks = [(d, b, b * 25, b * 25 + 20) for d in range(4) for b in range(4)]
    parts = U.segments(spark.createDataFrame(blocks, "document_id long, block int, start_offset int, end_offset int"), merged).collect()
    for d, b, lo, hi in blocks:
        mine = sorted((r["from"], r["to"], r["marked"]) for r in parts if (r["document_id"], r["block"]) == (d, b))
        assert mine[0][0] == lo and mine[-1][1] == hi and all(x[1] == y[0] for x, y in zip(mine, mine[1:], strict=False))
        assert all(m == any(e == d and p <= at < q for e, p, q in marks) for f, t, m in mine for at in range(f, t))


NODES = "document_id long, id string, entity_type string, label string, place int"
EDGES = "document_id long, type string, from_id string, to_id string"


def test_focus_falls_back(spark):
    """The duty with most edges; without duties a right, deadline or condition; else the first node; ties in order."""
    nodes = spark.createDataFrame(
        [(1, "o1", "obligation", "", 3), (1, "o2", "obligation", "", 2), (1, "c", "clause", "", 1), (2, "c", "clause", "", 1), (2, "d", "deadline", "", 2), (2, "k", "condition", "", 3), (3, "p", "party", "", 2), (3, "c", "clause", "", 1), (4, "o1", "obligation", "", 2), (4, "o2", "obligation", "", 1)], NODES
    )
    edges = spark.createDataFrame([(1, "t", "c", "o1"), (1, "t", "c", "o1"), (1, "t", "c", "o2"), (2, "t", "k", "c"), (3, "t", "p", "c")], EDGES)
    assert {r[0]: r[1] for r in R.default_focus(nodes, edges).collect()} == {1: "o1", 2: "k", 3: "c", 4: "o2"}


def test_focused_view_and_topics(spark):
    """Findings are no nodes but notes on what they are about; a focus of one's own, also on a finding; steps."""
    nodes = spark.createDataFrame([(1, "o", "obligation", "Pay", 1), (1, "c", "clause", "C", 2), (1, "p", "party", "P", 3), (1, "r", "risk", "R", 4), (1, "i", "inconsistency", "I", 5), (1, "d", "deadline", "D", 6)], NODES)
    edges = spark.createDataFrame([(1, "clause-imposes-obligation", "c", "o"), (1, "risk-about", "r", "c"), (1, "party-obligated-by", "p", "o"), (1, "inconsistency-between", "i", "r"), (1, "clause-sets-deadline", "c", "d")], EDGES)
    show = lambda **more: sorted((r["id"], r["depth"], r["findings"]) for r in R.focused_view(nodes, edges, **more)[0].collect())
    assert show() == [("c", 1, ["r"]), ("o", 0, []), ("p", 1, [])]
    assert show(depth=2) == [("c", 1, ["r"]), ("d", 2, []), ("o", 0, []), ("p", 1, [])]
    own = lambda node: spark.createDataFrame([(1, node)], "document_id long, focus string")
    assert show(focus=own("r")) == [("c", 1, ["r"]), ("r", 0, [])] and show(focus=own("zz")) == show()
    assert [(r["topic"], r["id"]) for r in R.topics(nodes).orderBy("topic").collect()] == [(1, "o"), (2, "i"), (3, "d")]
    kept, left = R.in_groups(nodes, edges, ["parties", "duties"])
    assert {r["id"] for r in kept.collect()} == {"o", "p"} and left.count() == 1


def test_rows_and_search(spark):
    nodes = spark.createDataFrame([(1, "p", "party", "Acme", 1), (1, "o", "obligation", "Pay", 2), (1, "x", "widget", "Odd", 3)], NODES)
    edges = spark.createDataFrame([(1, "party-obligated-by", "p", "o"), (1, "obligation-owed-to", "o", "gone")], EDGES)
    rows = {r["id"]: r for r in R.rows(nodes, edges).collect()}
    assert [(k["phrase"], k["category"], k["other_label"], k["other_type_label"]) for k in rows["o"]["links"]] == [("is obligated by (incoming)", "duties", "Acme", "Party"), ("is owed to", "duties", "gone", "Entity")]
    assert (rows["x"]["type_label"], rows["x"]["links"], rows["x"]["evidence_count"], rows["x"]["provenance"]) == ("Entity", [], 0, "unknown")
    assert {r["id"] for r in R.rows(nodes, edges, " ACME ").collect()} == {"p", "o"}
    found = lambda text: {r["id"] for r in R.search(nodes, text).collect()}
    assert (found("OBLIG"), found("entity"), found(" "), found(None), found("zz")) == ({"o"}, {"x"}, {"p", "o", "x"}, {"p", "o", "x"}, set())


def test_a_long_path(spark):
    """A chain of ten with a shortcut that is longer, a pair apart, a pair of one node."""
    edges = spark.createDataFrame([(1, "t", f"n{i}", f"n{i + 1}") for i in range(10)] + [(1, "t", "n0", "z"), (2, "t", "n0", "n10")], EDGES)
    pairs = spark.createDataFrame([(1, "n10", "n0"), (1, "n3", "n3"), (1, "n0", "far"), (2, "n0", "n10")], "document_id long, a string, b string")
    got = {(r["document_id"], r["a"], r["b"]): r["path"] for r in R.shortest_paths(edges, pairs, most=50).collect()}
    assert got == {(1, "n10", "n0"): [f"n{i}" for i in range(10, -1, -1)], (1, "n3", "n3"): ["n3"], (1, "n0", "far"): None, (2, "n0", "n10"): ["n0", "n10"]}


def test_tracker_state():
    """Late and repeated reports, unknown stages, no status, stages after a failure."""
    reports = [(1, "10:00", "received", "active", None), (4, "10:03", "text-extracted", "failed", "no text"), (2, "10:01", "received", None, "all"), (1, "10:00", "received", "active", None), (3, "10:02", "nowhere", "done", None)]
    state = {}
    for seq, at, stage, status, message in reports:
        T.taken(state, seq, f"2024-01-01 {at}", stage, status, message)
    rows = T.shown("r", state)
    assert rows["status"].tolist() == ["done", "failed"] + ["skipped"] * 5 and rows["message"].tolist()[:3] == ["all", "no text", None]
    assert rows["started_at"][0] == datetime(2024, 1, 1, 10, 0) and rows["ended_at"][0] == datetime(2024, 1, 1, 10, 1) and rows["seq"][0] == 2
    assert T.shown("r", {})["status"].tolist() == ["pending"] * 7
    for order in ([4, 3, 2, 1, 0], [2, 2, 0, 1, 4, 3, 1]):
        again = {}
        for i in order:
            seq, at, stage, status, message = reports[i]
            T.taken(again, seq, f"2024-01-01 {at}", stage, status, message)
        assert T.shown("r", again).equals(rows)


def test_dictionary_by_all_pairs(spark):
    """Names within names and words, any case, of a large dictionary in one shard and in several; nulls and empty names."""
    rng = random.Random(7)
    names = [None, "", "Ann", "annual", "ANN", "é b"] + ["".join(rng.choice("abc ") for _ in range(rng.randint(2, 5))) for _ in range(3_000)]
    texts = [(1, None), (2, ""), (3, "Bi-Annual É B"), (None, "ann")] + [(i, "".join(rng.choice("abcA ") for _ in range(60))) for i in range(4, 40)]
    want = sorted({(i, n.lower()) for i, t in texts if i is not None and t for n in names if n and n.lower() in t.lower()})
    table, dictionary = spark.createDataFrame(texts, "k long, text string"), spark.createDataFrame([(n,) for n in names], "name string")
    for size in (8 << 20, 3_000):
        assert sorted(map(tuple, N.find(table, dictionary, ["k"], size).collect())) == want
    assert N.find(table, dictionary.limit(0), ["k"]).count() == 0


def test_plain_form_is_that_of_the_columns(spark):
    """The form with offsets equals the column's, and offsets point at the characters that they came from."""
    rng = random.Random(9)
    letters = list("aB \t\n\r‘”\u200b\u00a0\u2003İß.\x07") + ["\r\n", "\n\n\n\n", " \n"]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    want = [r["p"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(V.comparable(V.F.col("t")).alias("p")).collect()]
    for text, form in zip(texts, want, strict=True):
        got, at = V.plain(text)
        assert got == form and len(at) == len(got) and at == sorted(at)
        assert all(text[i].lower().translate(V._STRAIGHT).startswith(c) or c == " " or len(text[i].lower()) > 1 for c, i in zip(got, at, strict=True))


def test_quote_places(spark):
    content = spark.createDataFrame([(1, "The “Buyer”\n shall\u200b PAY."), (2, None)], "document_id long, text string")
    quotes = spark.createDataFrame([(1, "a", '"buyer" shall pay'), (1, "b", " the "), (1, "c", "seller"), (1, "d", ""), (1, "e", None), (2, "f", "x"), (3, "g", "pay")], "document_id long, k string, source_text string")
    got = {r["k"]: (r["start_offset"], r["end_offset"]) for r in V.quote_places(quotes, content, "k").collect()}
    assert got == {"a": (4, 23), "b": (0, 3)} | {k: (-1, -1) for k in "cdefg"}


def test_plain_by_word_as_by_character():
    """words at once give the form and the offsets that single characters give."""
    rng = random.Random(11)
    for n in range(2000):
        text = "".join(rng.choice("aB.'\" \t\n\r\f-") for _ in range(n % 40))
        assert V._plain_by_word(text) == V._plain_by_character(text) == V.plain(text)
    assert V.plain("A \u200b‘b’") == V._plain_by_character("A \u200b‘b’") == ("a 'b'", [0, 1, 3, 4, 5])
