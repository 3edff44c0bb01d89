"""Relationships and graph queries (R1 to R18): validation, derivation, traversal, paths, cycles, views."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..schemas import edge_schema
from ..shared import by_document, discard, lay, meet, without, written, written_tables
from ..shipping import ship

EDGE = ["document_id", "type", "from_id", "from_type", "to_id", "to_type"]


def validate_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """R2: the first reason against each proposed edge, null if it stands.

    ``edges(document_id, ord, type, from_id, to_id)``, ``nodes(document_id, id, entity_type)``. The
    schema table has a few hundred rows whatever the data, so it is broadcast.
    """
    allowed = edge_schema(edges.sparkSession)
    a = nodes.select("document_id", F.col("id").alias("from_id"), F.col("entity_type").alias("from_type"))
    b = nodes.select("document_id", F.col("id").alias("to_id"), F.col("entity_type").alias("to_type"))
    x = edges.select("document_id", "ord", "type", "from_id", "to_id").join(a, ["document_id", "from_id"], "left").join(b, ["document_id", "to_id"], "left")
    x = x.join(F.broadcast(allowed.select("type").distinct().withColumn("known", F.lit(True))), "type", "left").join(F.broadcast(allowed.withColumn("fits", F.lit(True))), ["type", "from_type", "to_type"], "left")
    reason = (
        F.when(F.col("known").isNull(), "unknown-type")
        .when(F.col("from_id").isNull() | F.col("to_id").isNull(), "missing-endpoint")
        .when(F.col("from_type").isNull() | F.col("to_type").isNull(), "unknown-endpoint")
        .when(F.col("fits").isNull(), "type-mismatch")
    )
    x = x.withColumn("reason", reason)
    w = Window.partitionBy("document_id", "type", "from_id", "to_id", F.col("reason").isNull()).orderBy("ord")
    return x.withColumn("reason", F.when(F.col("reason").isNull() & (F.row_number().over(w) > 1), "duplicate").otherwise(F.col("reason"))).select("document_id", "ord", "type", "from_id", "to_id", "reason")


def edge(rows: DataFrame, kind: str, from_id: str, from_type: str, to_id: str, to_type: str) -> DataFrame:
    lit = lambda x: F.lit(x)
    return rows.where(F.col(from_id).isNotNull() & F.col(to_id).isNotNull()).select(
        "document_id", lit(kind).alias("type"), F.col(from_id).cast("string").alias("from_id"), lit(from_type).alias("from_type"), F.col(to_id).cast("string").alias("to_id"), lit(to_type).alias("to_type")
    )


def _dealt(rows: DataFrame, nodes: list[str], ends: list[tuple[str, str, str, str, str]]) -> DataFrame:
    """A table's nodes (``type`` null, the id in ``from_id``) and edges ``(type, from_id, from_type, to_id, to_type)``, as one list a row."""
    text = lambda name: F.col(name).cast("string")
    null = F.lit(None).cast("string")
    one = lambda kind, a, a_type, b, b_type: F.struct(kind.alias("type"), a.alias("from_id"), a_type.alias("from_type"), b.alias("to_id"), b_type.alias("to_type"))
    every = [one(null, text(k), null, null, null) for k in nodes] + [one(F.lit(kind), text(a), F.lit(a_type), text(b), F.lit(b_type)) for kind, a, a_type, b, b_type in ends]
    return rows.where("document_id is not null").select("document_id", F.array(*every).alias("every"))


def derive_edges(clauses: DataFrame, parties: DataFrame, obligations: DataFrame, rights: DataFrame, deadlines: DataFrame, references: DataFrame | None = None, existing: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Edges that follow from the foreign keys, each once, without self-loops, open ends and those that exist.

    The rows of all tables are dealt out once, by document, unless they are ``dealt``; nodes and edges then meet by windows where they lie.
    """
    every = [
        _dealt(parties, ["id", "document_id"], [("document-has-party", "document_id", "document", "id", "party")]),
        _dealt(clauses, ["clause_id", "document_id"], [("document-has-clause", "document_id", "document", "clause_id", "clause")]),
        _dealt(obligations, ["id"], [
            ("clause-imposes-obligation", "clause_id", "clause", "id", "obligation"), ("party-obligated-by", "obligor_party_id", "party", "id", "obligation"),
            ("obligation-owed-to", "id", "obligation", "obligee_party_id", "party"), ("obligation-has-deadline", "id", "obligation", "deadline_id", "deadline"),
        ]),
        _dealt(rights, ["id"], [("clause-grants-right", "clause_id", "clause", "id", "right"), ("party-holds-right", "holder_party_id", "party", "id", "right"), ("right-held-against", "id", "right", "counterparty_party_id", "party")]),
        _dealt(deadlines, ["id"], [("clause-sets-deadline", "clause_id", "clause", "id", "deadline")]),
    ]
    if references is not None:
        every.append(_dealt(references, [], [("clause-references", "clause_id", "clause", "to_clause_id", "clause")]))
    out = by_document(reduce(DataFrame.unionByName, every), dealt).select("deal", "document_id", F.inline("every"))
    out = out.where("from_id is not null and (type is null or to_id is not null and from_id <> to_id)").distinct()
    for end in ("from_id", "to_id"):
        # A node's own row lies with the edges that end at it.
        there = F.max(F.col("type").isNull()).over(Window.partitionBy("deal", "document_id", F.coalesce(end, "from_id")))
        out = out.withColumn("there", there).where("there")
    out = out.where("type is not null")
    if existing is not None:
        out = out.join(existing.select("document_id", "type", "from_id", "to_id"), ["document_id", "type", "from_id", "to_id"], "left_anti")
    return out.select(EDGE)


def build(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The edges with both ends, and the broken ones."""
    ids = nodes.select("document_id", "id")
    whole = edges.join(ids.withColumnRenamed("id", "from_id"), ["document_id", "from_id"], "left_semi").join(ids.withColumnRenamed("id", "to_id"), ["document_id", "to_id"], "left_semi")
    return whole, broken(nodes, edges)


def broken(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node."""
    a = nodes.select("document_id", F.col("id").alias("from_id"), F.lit(True).alias("a"))
    b = nodes.select("document_id", F.col("id").alias("to_id"), F.lit(True).alias("b"))
    return edges.join(a, ["document_id", "from_id"], "left").join(b, ["document_id", "to_id"], "left").where("a is null or b is null").drop("a", "b")


def both_ways(edges: DataFrame) -> DataFrame:
    """``(document_id, node, neighbour, type, direction)`` of every edge from either end; edges are made once for both."""
    way = lambda x, y, direction: F.struct(F.col(x).alias("node"), F.col(y).alias("neighbour"), F.col("type").alias("type"), F.lit(direction).alias("direction"))
    return edges.select("document_id", F.inline(F.array(way("from_id", "to_id", "out"), way("to_id", "from_id", "in"))))


def neighbours(edges: DataFrame, node: str, types: list[str] | None = None, direction: str | None = None) -> DataFrame:
    """Neighbours of one node, by edge type and direction if wanted."""
    rows = both_ways(edges).where(F.col("node") == node)
    rows = rows.where(F.col("type").isin(types)) if types else rows
    return (rows.where(F.col("direction") == direction) if direction else rows).distinct()


def reach(edges: DataFrame, start: DataFrame, levels: int, directed: bool = False, dealt: bool = False) -> DataFrame:
    """``start(document_id, id)`` to ``(document_id, id, depth, via)`` of all within ``levels`` steps, each at its least depth.

    One join a level on the frontier and an anti-join with what was seen; of equal ways in, the
    smallest neighbour is ``via``.
    """
    links = both_ways(edges)
    links = (links.where("direction = 'out'") if directed else links).select("document_id", "node", "neighbour").distinct()
    seen = start.select("document_id", "id", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("via"))
    frontier = seen
    for depth in range(1, levels + 1):
        near = meet(links, frontier.select("document_id", F.col("id").alias("node")), ["document_id", "node"], "inner", dealt).groupBy("document_id", F.col("neighbour").alias("id")).agg(F.min("node").alias("via"))
        frontier = without(near, seen, ["document_id", "id"], dealt).select("document_id", "id", F.lit(depth).alias("depth"), "via")
        seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, keep: DataFrame, dealt: bool = False) -> DataFrame:
    """Edges among the kept nodes: both are dealt out once, by document, unless they are ``dealt``, and each end meets the nodes by a window."""
    ids = keep.where("id is not null").select("document_id", F.col("id").alias("kept")).distinct()
    both = edges.select("document_id", F.struct(*[c for c in edges.columns if c != "document_id"]).alias("e")).unionByName(ids, allowMissingColumns=True)
    both = by_document(both.where("document_id is not null"), dealt)
    for end in ("from_id", "to_id"):
        there = F.max(F.col("kept").isNotNull()).over(Window.partitionBy("deal", "document_id", F.coalesce("kept", F.col(f"e.{end}"))))
        both = both.withColumn("there", there).where("there")
    return both.where("kept is null").select("document_id", "e.*").select(edges.columns)


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an edge."""
    touched = edges.select("document_id", F.col("from_id").alias("id")).unionByName(edges.select("document_id", F.col("to_id").alias("id")))
    return nodes.join(touched, ["document_id", "id"], "left_anti")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes, edges, orphans and average degree of each document."""
    n = nodes.groupBy("document_id").agg(F.count("*").alias("nodes"))
    e = edges.groupBy("document_id").agg(F.count("*").alias("edges"))
    o = orphans(nodes, edges).groupBy("document_id").agg(F.count("*").alias("orphans"))
    out = n.join(e, "document_id", "left").join(o, "document_id", "left").na.fill(0)
    return out.withColumn("average_degree", F.round(2 * F.col("edges") / F.col("nodes"), 2))


def degrees(edges: DataFrame) -> DataFrame:
    return both_ways(edges).groupBy("document_id", F.col("node").alias("id")).agg(F.count("*").alias("degree"))


def clusters(nodes: DataFrame, edges: DataFrame, most: int = 10) -> DataFrame:
    """Of each entity type the nodes with most edges, then by label; and how many are hidden."""
    ranked = nodes.join(degrees(edges), ["document_id", "id"], "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    w = Window.partitionBy("document_id", "entity_type")
    ranked = ranked.withColumn("place", F.row_number().over(w.orderBy(F.desc("degree"), "label", "id"))).withColumn("hidden", F.greatest(F.count("*").over(w) - most, F.lit(0)))
    return ranked.where(F.col("place") <= most)


def shortest_paths(edges: DataFrame, pairs: DataFrame, most: int = 6) -> DataFrame:
    """``pairs(document_id, a, b)`` to the nodes of a shortest undirected path, the smallest of equals; null beyond ``most`` steps.

    A search from ``a`` in rounds. Each frontier is written down, so that a round costs one join
    however many came before it, and the search ends with the first empty one: ``most`` may be as
    large as the longest path. Pairs that have met leave the search, as do nodes that a pair has seen.
    """
    key = ["document_id", "a", "b"]
    links, pairs = written_tables("links", both_ways(edges).select("document_id", "node", "neighbour").distinct(), pairs.select(key))
    live = written(lay(pairs).distinct().select(*key, F.array("a").alias("path"), F.col("a").alias("node")), "frontier")
    seen = [live]
    found = [live.where("node = b").select(*key, "path")]
    tables = [live]
    for _ in range(most):
        # Frontiers and links are dealt out once a round, by document, and what follows meets where it lies.
        front = lay(live)
        step = meet(front.where("node <> b"), lay(links), ["document_id", "node"], "inner", dealt=True).select(*key, "path", F.col("neighbour").alias("node"))
        before = reduce(DataFrame.unionByName, [*[lay(t.select(*key, "node")) for t in seen[:-1]], front.select(*key, "node")])
        # Of the paths to one node only the smallest goes on.
        near = without(step, before, [*key, "node"], dealt=True).groupBy(*key, "node").agg(F.min(F.concat("path", F.array("node"))).alias("path"))
        met = near.withColumn("met", F.max((F.col("node") == F.col("b")).cast("int")).over(Window.partitionBy(*key)))
        live = written(met.where("met = 0 or node = b").drop("met").select(live.columns), "frontier")
        tables.append(live)
        if not live.limit(1).count():
            break
        seen.append(live)
        found.append(live.where("node = b").select(*key, "path"))
    paths = written(reduce(DataFrame.unionByName, found), "paths")
    # Links lie beside the pairs, which the result reads.
    discard(*tables)
    return pairs.select(key).join(paths, key, "left")


def _walked(starts: list[str], ends: list[str], most: int) -> list[list[str]]:
    """The first ``most`` directed cycles of one document's edges, in order of discovery by a depth-first walk."""
    out: dict[str, list[str]] = {}
    for a, b in sorted(set(zip(starts, ends, strict=True))):
        out.setdefault(a, []).append(b)
    found, state = [], {}
    for start in sorted(out):
        if start in state:
            continue
        state[start], path, todo = 1, [start], [iter(out[start])]
        while todo and len(found) < most:
            step = next(todo[-1], None)
            if step is None:
                state[path.pop()] = 2
                todo.pop()
            elif state.get(step) == 1:
                found.append([*path[path.index(step) :], step])
            elif step not in state:
                state[step] = 1
                path.append(step)
                todo.append(iter(out.get(step, ())))
    return found


def cycles(edges: DataFrame, most: int = 25) -> DataFrame:
    """Directed cycles of each document in order of discovery, at most ``most``: a depth-first walk of one document's edges.

    A document is a row that holds its edges, so that many small ones are one batch.
    """
    ship(edges.sparkSession)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(doc, i, c) for doc, a, b in zip(batch["document_id"].tolist(), batch["starts"], batch["ends"], strict=True) for i, c in enumerate(_walked(list(a), list(b), most))]
            yield pd.DataFrame(rows, columns=["document_id", "cycle", "path"])

    # One list, so that starts and ends keep together.
    held = edges.groupBy("document_id").agg(F.collect_list(F.struct("from_id", "to_id")).alias("e"))
    lists = held.select("document_id", F.col("e.from_id").alias("starts"), F.col("e.to_id").alias("ends"))
    return lists.mapInPandas(walk, "document_id bigint, cycle int, path array<string>")


# What an edge type is about, and how it reads.
EDGE_WORDS = {
    "document-has-party": ("structure", "has party"),
    "document-has-clause": ("structure", "has clause"),
    "clause-references": ("reference", "references clause"),
    "clause-defines": ("structure", "defines"),
    "clause-imposes-obligation": ("duties", "imposes obligation"),
    "clause-grants-right": ("duties", "grants right"),
    "clause-states-condition": ("time", "states condition"),
    "clause-sets-deadline": ("time", "sets deadline"),
    "clause-states-consequence": ("findings", "states consequence"),
    "clause-flags-risk": ("findings", "flags risk"),
    "party-obligated-by": ("duties", "is obligated by"),
    "obligation-owed-to": ("duties", "is owed to"),
    "party-holds-right": ("duties", "holds right"),
    "right-held-against": ("duties", "is held against"),
    "obligation-triggered-by": ("time", "triggered by"),
    "obligation-has-deadline": ("time", "has deadline"),
    "obligation-results-in": ("findings", "results in"),
    "condition-triggers": ("time", "triggers"),
    "condition-has-deadline": ("time", "has deadline"),
    "consequence-follows-condition": ("findings", "follows condition"),
    "consequence-affected-party": ("findings", "affects party"),
    "definition-applies-to": ("reference", "applies to"),
    "deadline-anchored-to": ("time", "anchored to"),
    "risk-about": ("findings", "about"),
    "inconsistency-between": ("findings", "between"),
    "entity-relates-to": ("reference", "relates to"),
}


def _edge_word(kind: Column, at: int, other: Column) -> Column:
    words = F.create_map(*[F.lit(x) for k, w in EDGE_WORDS.items() for x in (k, w[at])])
    return F.coalesce(F.try_element_at(words, kind), other)


def semantics(kind: Column) -> Column:
    """The category of an edge type; plain associations and unknown types are references."""
    return _edge_word(kind, 0, F.lit("reference"))


def label(kind: Column) -> Column:
    """An edge type as words; of an unknown one its parts."""
    return _edge_word(kind, 1, F.replace(kind, F.lit("-"), F.lit(" ")))


# How each entity type reads, and the groups that a view switches on and off.
TYPE_LABELS = {
    "document": "Document", "clause": "Clause", "definition": "Definition", "party": "Party", "obligation": "Obligation", "right": "Right",
    "condition": "Condition", "deadline": "Deadline", "consequence": "Consequence", "risk": "Risk signal", "inconsistency": "Inconsistency",
}
GROUPS = {
    "document": ["document", "clause", "definition"],
    "parties": ["party"],
    "duties": ["obligation", "right"],
    "timing": ["condition", "deadline"],
    "findings": ["consequence", "risk", "inconsistency"],
}
FINDINGS = ["risk", "inconsistency"]


def type_label(entity_type: Column) -> Column:
    """An entity type as a reader sees it."""
    words = F.create_map(*[F.lit(x) for kv in TYPE_LABELS.items() for x in kv])
    return F.coalesce(F.try_element_at(words, entity_type), F.lit("Entity"))


def in_groups(nodes: DataFrame, edges: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """The nodes of some groups, and the edges among them."""
    kept = nodes.where(F.col("entity_type").isin([t for g in groups for t in GROUPS[g]]))
    return kept, subgraph(edges, kept)


def search(nodes: DataFrame, text: str | None) -> DataFrame:
    """Nodes whose label, type or type's label holds a text, whatever its case; all for an empty one."""
    needle = F.lit((text or "").strip().lower())
    hit = lambda value: F.contains(F.lower(F.coalesce(value, F.lit(""))), needle)
    return nodes.where(hit(F.col("label")) | hit(F.col("entity_type")) | hit(type_label(F.col("entity_type"))))


def rows(nodes: DataFrame, edges: DataFrame, text: str | None = None, dealt: bool = False) -> DataFrame:
    """Each node with its type, citations and what it is related to, as text.

    ``nodes(document_id, id, entity_type, label[, provenance, evidence_count])``, ``edges`` with
    ``provenance`` if known. ``links`` has of each edge the phrase, category, provenance and the
    other end, sorted; ``text`` keeps the rows whose label, type, phrases or neighbours hold it.
    Ends and nodes meet by windows; of ``dealt`` tables nothing is dealt out again.
    """
    have = lambda table, name, other: F.coalesce(F.col(name), F.lit(other)) if name in table.columns else F.lit(other)
    end = lambda x, y, tail: F.struct(F.col(x).alias("id"), F.col(y).alias("other_id"), F.lit(tail).alias("tail"))
    both = edges.select("document_id", "type", have(edges, "provenance", "unknown").alias("edge_provenance"), F.explode(F.array(end("from_id", "to_id", ""), end("to_id", "from_id", " (incoming)"))).alias("e"))
    ends = both.select("document_id", "e.other_id", F.struct("e.id", "e.tail", "type", "edge_provenance").alias("e"))
    known = nodes.where("document_id is not null and id is not null")
    others = known.select("document_id", F.col("id").alias("other_id"), F.struct(F.col("label").alias("other_label"), F.col("entity_type").alias("other_type")).alias("o"))
    near = by_document(ends.unionByName(others, allowMissingColumns=True), dealt)
    near = near.withColumn("all", F.collect_list("o").over(Window.partitionBy("deal", "document_id", "other_id"))).where("e is not null").select("document_id", "other_id", "e.*", F.explode_outer("all").alias("o")).select("*", "o.*")
    link = F.struct(
        F.concat(label(F.col("type")), "tail").alias("phrase"), semantics(F.col("type")).alias("category"), F.col("edge_provenance").alias("provenance"), "type", "other_id",
        F.coalesce("other_label", "other_id").alias("other_label"), F.when(F.col("other_type").isNull(), "Entity").otherwise(type_label(F.col("other_type"))).alias("other_type_label"),
    )
    linked = near.where("document_id is not null and id is not null").groupBy("document_id", "id").agg(F.array_sort(F.collect_list(link)).alias("links"))
    out = nodes.select("document_id", "id", F.struct("entity_type", "label", type_label(F.col("entity_type")).alias("type_label"), have(nodes, "provenance", "unknown").alias("provenance"), have(nodes, "evidence_count", 0).alias("evidence_count")).alias("n"))
    met = by_document(out.unionByName(linked, allowMissingColumns=True), dealt)
    met = met.withColumn("links", F.first("links", ignorenulls=True).over(Window.partitionBy("deal", "document_id", "id"))).where("n is not null")
    out = met.select("document_id", "id", "n.*", F.coalesce("links", F.array().cast(linked.schema["links"].dataType)).alias("links"))
    said = F.lower(F.concat_ws(" ", "label", "type_label", F.transform("links", lambda k: F.concat_ws(" ", k["phrase"], k["other_label"]))))
    return out.where(F.contains(said, F.lit((text or "").strip().lower())))


def with_findings(nodes: DataFrame, edges: DataFrame, findings: DataFrame, dealt: bool = False) -> tuple[DataFrame, DataFrame]:
    """Finding nodes, and edges from them to the clauses that are there. Of ``dealt`` tables nothing is dealt out again."""
    more = findings.select("document_id", F.col("finding_id").alias("id"), F.lit("risk").alias("entity_type"), F.col("title").alias("label"))
    links = edge(findings.withColumn("id", F.col("finding_id")), "risk-about", "id", "risk", "clause_id", "clause")
    there = nodes.where("document_id is not null and id is not null").select("document_id", F.col("id").alias("to_id"), F.lit(True).alias("node"))
    met = by_document(links.unionByName(there, allowMissingColumns=True), dealt)
    links = met.withColumn("node", F.max("node").over(Window.partitionBy("deal", "document_id", "to_id"))).where("from_id is not null and node")
    return nodes.select("document_id", "id", "entity_type", "label").unionByName(more), edges.select(EDGE).unionByName(links.select(EDGE))


def default_focus(nodes: DataFrame, edges: DataFrame, dealt: bool = False) -> DataFrame:
    """Where a view starts: the duty with most edges, else the right, deadline or condition with most, else the first node.

    ``nodes`` are in the order of ``place``, which also decides between equals.
    """
    turn = F.when(F.col("entity_type") == "obligation", 0).when(F.col("entity_type").isin("right", "deadline", "condition"), 1).otherwise(2)
    # Nodes and ends meet in one count and not in a join, dealt out by document: rows of one document side by side take less room.
    ends = edges.select("document_id", F.explode(F.array("from_id", "to_id")).alias("id")).where("id is not null")
    n = nodes.select("document_id", "id", F.struct(turn.alias("turn"), "place").alias("node")).unionByName(ends, allowMissingColumns=True)
    n = by_document(n, dealt).groupBy("deal", "document_id", "id").agg(F.min("node").alias("node"), F.count(F.when(F.col("node").isNull(), 1)).alias("degree")).where("node is not null")
    rank = F.struct("node.turn", F.when(F.col("node.turn") < 2, -F.col("degree")).otherwise(0).alias("minus"), "node.place")
    return n.groupBy("deal", "document_id").agg(F.min_by("id", rank).alias("focus")).drop("deal")


def topics(nodes: DataFrame, most: int = 6) -> DataFrame:
    """What a reader may start from: the first three duties, one inconsistency and two deadlines of each document."""
    # How many of each type, in this order.
    take = {"obligation": 3, "inconsistency": 1, "deadline": 2}
    chain = lambda values: reduce(lambda acc, t: acc.when(F.col("entity_type") == t, values[t]), take, F.when(F.lit(False), 0))
    ranked = nodes.withColumn("nth", F.row_number().over(Window.partitionBy("document_id", "entity_type").orderBy("place"))).where(F.col("nth") <= chain(take))
    order = Window.partitionBy("document_id").orderBy(chain({t: i for i, t in enumerate(take)}), "nth")
    return ranked.withColumn("topic", F.row_number().over(order)).where(F.col("topic") <= most).select("document_id", "topic", "id", "label", F.col("entity_type").alias("type"))


def focused_view(nodes: DataFrame, edges: DataFrame, focus: DataFrame | None = None, depth: int = 1) -> tuple[DataFrame, DataFrame]:
    """Nodes within ``depth`` steps of each document's focus, with the findings on them, and the edges among them.

    ``focus(document_id, focus)`` may name a node; a document where it names none starts at
    :func:`default_focus`. Risks and inconsistencies are no nodes of the view, unless one is its
    focus; they are listed in ``findings`` of what they are about.
    """
    # Read by every step below: written and dealt out once, and what follows meets where it lies.
    nodes, edges = (lay(t) for t in written_tables("view", nodes, edges))
    key = ["document_id", "id"]
    start = default_focus(nodes, edges, dealt=True)
    if focus is not None:
        named = focus.join(nodes.select("document_id", F.col("id").alias("focus")), ["document_id", "focus"], "left_semi").withColumnRenamed("focus", "named")
        start = start.join(named, "document_id", "left").select("document_id", F.coalesce("named", "focus").alias("focus"))
    primary = nodes.join(start, "document_id").where((F.col("id") == F.col("focus")) | ~F.col("entity_type").isin(FINDINGS))
    among = subgraph(edges, primary, dealt=True)
    near = reach(among, start.select("document_id", F.col("focus").alias("id")), depth, dealt=True).select("document_id", "id", "depth")
    seen = meet(primary, near, key, "inner", dealt=True)
    finding = nodes.where(F.col("entity_type").isin(FINDINGS)).select("document_id", F.col("id").alias("node"))
    about = meet(both_ways(edges).select("document_id", "node", "neighbour"), finding, ["document_id", "node"], "inner", dealt=True).select("document_id", F.col("neighbour").alias("id"), F.col("node").alias("finding"))
    about = without(about, finding.withColumnRenamed("node", "id"), key, dealt=True).groupBy("document_id", "id").agg(F.array_sort(F.collect_list("finding")).alias("findings"))
    shown = meet(seen, about, key, "left", dealt=True).withColumn("findings", F.coalesce("findings", F.array().cast("array<string>")))
    return shown.select("document_id", "id", "entity_type", "label", "depth", "findings"), subgraph(among, shown, dealt=True)
