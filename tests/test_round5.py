"""Graph steps that meet by document where their rows lie, on small tables."""

from lexspark.operators import graph as R


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_edges_without_joins(spark):
    """Repeats, self-loops, open ends, ends of another document and ends that are no node leave; a table is dealt out once and joins nothing."""
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    clauses = table([(1, "c"), (1, "c"), (2, "e"), (None, "c")], "document_id long, clause_id string")
    parties = table([(1, "p"), (1, None), (2, "q"), (2, "2")], "document_id long, id string")
    duties = table([(1, "o", "c", "p", "q", "d"), (1, "o", "c", "p", "q", "d"), (2, "u", "c", "q", None, "d")], "document_id long, id string, clause_id string, obligor_party_id string, obligee_party_id string, deadline_id string")
    rights = table([(1, "r", None, "p", "r")], "document_id long, id string, clause_id string, holder_party_id string, counterparty_party_id string")
    deadlines = table([(1, "d", "c")], "document_id long, id string, clause_id string")
    references = table([(1, "c", "c"), (2, "e", "lost"), (2, "lost", "e")], "document_id long, clause_id string, to_clause_id string")
    got = R.derive_edges(clauses, parties, duties, rights, deadlines, references)
    assert "Join" not in plan(got)
    want = [
        (1, "clause-imposes-obligation", "c", "clause", "o", "obligation"), (1, "clause-sets-deadline", "c", "clause", "d", "deadline"), (1, "document-has-clause", "1", "document", "c", "clause"), (1, "document-has-party", "1", "document", "p", "party"),
        (1, "obligation-has-deadline", "o", "obligation", "d", "deadline"), (1, "party-holds-right", "p", "party", "r", "right"), (1, "party-obligated-by", "p", "party", "o", "obligation"),
        (2, "document-has-clause", "2", "document", "e", "clause"), (2, "document-has-party", "2", "document", "q", "party"), (2, "party-obligated-by", "q", "party", "u", "obligation"),
    ]
    assert sorted(map(tuple, got.collect())) == want
    known = table([(1, "party-holds-right", "p", "r")], "document_id long, type string, from_id string, to_id string")
    assert sorted(map(tuple, R.derive_edges(clauses, parties, duties, rights, deadlines, references, known).collect())) == [e for e in want if e[1] != "party-holds-right"]


def test_subgraph_and_focus_without_joins(spark):
    """Edges of another document, open ends and repeats of a kept node; ends that are no node do not count as duties."""
    nodes = spark.createDataFrame([(1, "a", "right", 2), (1, "b", "right", 1), (1, "b", "clause", 3), (2, "a", "clause", 5), (2, "z", "party", 4)], "document_id long, id string, entity_type string, place int")
    edges = spark.createDataFrame([(1, "x", "a", "b"), (1, "x", "a", "b"), (1, "y", "a", "lost"), (1, "y", None, "a"), (2, "x", "a", "b"), (2, "x", "z", "a"), (None, "x", "a", "b")], "document_id long, type string, from_id string, to_id string")
    kept, focus = R.subgraph(edges, nodes), R.default_focus(nodes, edges)
    assert "Join" not in plan(kept) + plan(focus)
    assert sorted(map(tuple, kept.collect())) == [(1, "x", "a", "b"), (1, "x", "a", "b"), (2, "x", "z", "a")]
    assert sorted(map(tuple, focus.collect())) == [(1, "a"), (2, "z")]
