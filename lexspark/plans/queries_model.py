"""Queries over evidence, the relationship graph, versions, questions, review, validation, drafts and views."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, question_terms
from ..operators import ask as A
from ..operators import compare as M
from ..operators import drafts as X
from ..operators import evidence as V
from ..operators import graph as R
from ..operators import prepare as P
from ..operators import validate as L
from ..operators import views as U
from ..shared import written
from ..sources.ingest import search_clauses
from .corpus import corpus, ctes
from .model import as_of, model
from .queries_duties import DUTIES, INCONSISTENCIES, SIGNALS, inconsistencies, judged, sql_cut
from .queries_text import _content, sql_clause_type
from .registry import query

# --- evidence ----------------------------------------------------------------------------------

_QUOTES = """quotes AS (SELECT CASE WHEN document_id % 11 = 5 THEN -document_id ELSE document_id END AS document_id, concat('o', clause_id) AS entity_id,
  CASE WHEN document_id % 11 = 5 THEN 'other-document' ELSE CASE ord % 4 WHEN 0 THEN 'text-mismatch' WHEN 1 THEN 'unknown-clause' WHEN 2 THEN 'missing-text' ELSE 'verified' END END AS status FROM corpus_a)"""


def quotes(spark, sf_dir, m=None):
    a = m.a if m else corpus(spark, sf_dir, "corpus_a")[0]
    n = F.col("ord") % 4
    rows = a.select(
        F.when(F.col("document_id") % 11 == 5, -F.col("document_id")).otherwise(F.col("document_id")).alias("document_id"), F.concat(F.lit("o"), "clause_id").alias("entity_id"), F.lit("obligation").alias("entity_type"),
        F.when(n == 1, "nowhere").otherwise(F.col("clause_id")).alias("clause_id"), F.when(n == 0, "words of another text").when(n == 2, "").otherwise(F.upper("text")).alias("source_text"),
        F.lit(1).alias("page"), F.lit(None).cast("int").alias("start_offset"), F.lit(None).cast("int").alias("end_offset"), F.lit(None).cast("string").alias("id"),
    )
    return V.verify(V.normalize(rows), _content(a).withColumn("page_count", F.lit(1)), a)


@query("evidence_verify", "V1 V2 V3 V12", ctes("corpus_a") + f", {_QUOTES} SELECT document_id, entity_id, status FROM quotes")
def evidence_verify(spark, sf_dir):
    return quotes(spark, sf_dir).select("document_id", "entity_id", "status")


_GOOD = "facts AS (SELECT o.document_id, o.obligation_id, o.clause_id, q.status FROM corpus_obligations o LEFT JOIN quotes q ON q.document_id = o.document_id AND q.entity_id = o.obligation_id)"


@query(
    "evidence_coverage", "V5 V6",
    ctes("corpus_obligations") + f", {_QUOTES}, {_GOOD} SELECT document_id, count(*) AS facts, count(status) AS with_evidence, count(*) FILTER (status = 'verified') AS verified, round(count(*) FILTER (status = 'verified') / count(*), 4) AS ratio FROM facts GROUP BY document_id",
)
def evidence_coverage(spark, sf_dir):
    facts = V.collect_facts({"obligation": model(spark, sf_dir).obligations})
    return V.coverage(facts, quotes(spark, sf_dir))


@query(
    "clause_evidence", "V8 V9",
    ctes("corpus_obligations") + f""", {_QUOTES}, {_GOOD} SELECT document_id, clause_id, count(*) AS pairs, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status <> 'verified') AS unverified, count(*) FILTER (status IS NULL) AS missing
      FROM facts GROUP BY GROUPING SETS ((document_id, clause_id), (document_id))""",
)
def clause_evidence(spark, sf_dir):
    return V.roll_up(V.collect_facts({"obligation": model(spark, sf_dir).obligations}), quotes(spark, sf_dir))


@query("evidence_rejected", "V4", ctes("corpus_obligations") + f", {_QUOTES}, {_GOOD} SELECT document_id, obligation_id FROM facts WHERE status IS DISTINCT FROM 'verified'")
def evidence_rejected(spark, sf_dir):
    facts = V.collect_facts({"obligation": model(spark, sf_dir).obligations})
    return V.rejected(facts, quotes(spark, sf_dir)).select("document_id", F.col("id").alias("obligation_id"))


# --- graph -------------------------------------------------------------------------------------


def _sql_edge(kind: str, a: str, b: str, table: str, where: str = "true") -> str:
    return f"SELECT document_id, '{kind}' AS type, {a} AS from_id, {b} AS to_id FROM {table} WHERE {a} IS NOT NULL AND {b} IS NOT NULL AND {where}"


_DERIVED = "derived AS (SELECT DISTINCT * FROM (" + " UNION ALL ".join([
    _sql_edge("document-has-party", "CAST(document_id AS VARCHAR)", "party_id", "corpus_parties"), _sql_edge("document-has-clause", "CAST(document_id AS VARCHAR)", "clause_id", "corpus_a"),
    _sql_edge("clause-imposes-obligation", "clause_id", "obligation_id", "corpus_obligations"), _sql_edge("party-obligated-by", "obligor_id", "obligation_id", "corpus_obligations"),
    _sql_edge("obligation-owed-to", "obligation_id", "obligee_id", "corpus_obligations"), _sql_edge("obligation-has-deadline", "obligation_id", "deadline_id", "corpus_obligations"),
    _sql_edge("clause-grants-right", "clause_id", "right_id", "corpus_rights"), _sql_edge("party-holds-right", "holder_id", "right_id", "corpus_rights"),
    _sql_edge("right-held-against", "right_id", "counterparty_id", "corpus_rights"), _sql_edge("clause-sets-deadline", "clause_id", "deadline_id", "corpus_deadlines"),
]) + ") u)"


@query("edges_derive", "R1 R3", DUTIES + f", {_DERIVED} SELECT * FROM derived")
def edges_derive(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.derive_edges(m.clauses, m.parties, m.obligations, m.rights, m.deadlines).select("document_id", "type", "from_id", "to_id")


def _nodes(m):
    return m.parties.select("document_id", "id", F.lit("party").alias("entity_type"), F.col("name").alias("label")).unionByName(m.obligations.select("document_id", "id", F.lit("obligation").alias("entity_type"), F.col("summary").alias("label")))


_NODES = "nodes AS (SELECT document_id, party_id AS id, 'party' AS entity_type, name AS label FROM corpus_parties UNION ALL SELECT document_id, obligation_id, 'obligation', summary FROM corpus_obligations)"


def _owes(m):
    return m.obligations.select("document_id", F.lit("party-obligated-by").alias("type"), F.col("obligor_party_id").alias("from_id"), F.col("id").alias("to_id"), "ord")


def _owed(m):
    return m.obligations.select("document_id", F.lit("obligation-owed-to").alias("type"), F.col("id").alias("from_id"), F.col("obligee_party_id").alias("to_id"), "ord")


@query(
    "edge_validate", "R2",
    DUTIES + "SELECT document_id, ord, CASE ord % 5 WHEN 0 THEN 'unknown-type' WHEN 2 THEN 'unknown-endpoint' WHEN 3 THEN 'missing-endpoint' WHEN 4 THEN 'type-mismatch' END AS reason FROM corpus_obligations",
)
def edge_validate(spark, sf_dir):
    m = model(spark, sf_dir)
    n = F.col("ord") % 5
    e = _owes(m).withColumn("type", F.when(n == 0, "no-such-type").when(n == 4, "obligation-owed-to").otherwise(F.col("type")))
    e = e.withColumn("to_id", F.when(n == 2, "lost").otherwise(F.col("to_id"))).withColumn("from_id", F.when(n == 3, None).otherwise(F.col("from_id")))
    return R.validate_edges(e, _nodes(m)).select("document_id", "ord", "reason")


@query(
    "graph_stats", "R11",
    DUTIES + f""", {_NODES}, n AS (SELECT document_id, count(*) AS nodes, count(*) FILTER (NOT EXISTS (SELECT 1 FROM corpus_obligations o WHERE o.document_id = nodes.document_id AND (o.obligor_id = nodes.id OR o.obligation_id = nodes.id))) AS orphans FROM nodes GROUP BY document_id),
      e AS (SELECT document_id, count(*) AS edges FROM corpus_obligations GROUP BY document_id) SELECT n.document_id, nodes, coalesce(edges, 0) AS edges, orphans, round(2 * coalesce(edges, 0) / nodes, 2) AS average_degree FROM n LEFT JOIN e USING (document_id)""",
)
def graph_stats(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.stats(_nodes(m), _owes(m))


@query("graph_orphans", "R9", DUTIES + f", {_NODES} SELECT document_id, id FROM nodes WHERE NOT EXISTS (SELECT 1 FROM corpus_obligations o WHERE o.document_id = nodes.document_id AND (o.obligor_id = nodes.id OR o.obligation_id = nodes.id))")
def graph_orphans(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.orphans(_nodes(m), _owes(m)).select("document_id", "id")


@query("graph_broken", "R9", DUTIES + "SELECT o.document_id, o.obligation_id AS from_id, o.deadline_id AS to_id FROM corpus_obligations o JOIN corpus_deadlines d ON d.deadline_id = o.deadline_id AND d.date_type = 'unspecified'")
def graph_broken(spark, sf_dir):
    m = model(spark, sf_dir)
    nodes = m.obligations.select("document_id", "id").unionByName(m.deadlines.where("date_type <> 'unspecified'").select("document_id", "id"))
    edges = m.obligations.where("deadline_id is not null").select("document_id", F.col("id").alias("from_id"), F.col("deadline_id").alias("to_id"))
    return R.broken(nodes, edges)


@query("neighbours", "R5", DUTIES + "SELECT document_id, obligation_id AS neighbour, 'obligation-owed-to' AS type, 'in' AS direction FROM corpus_obligations WHERE obligee_id = 's7'")
def neighbours(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.neighbours(_owes(m).unionByName(_owed(m)), "s7").select("document_id", "neighbour", "type", "direction")


@query(
    "bfs_levels", "R6",
    DUTIES + """SELECT DISTINCT document_id, obligor_id AS id, 0 AS depth, CAST(NULL AS VARCHAR) AS via FROM corpus_obligations UNION ALL SELECT document_id, obligation_id, 1, obligor_id FROM corpus_obligations
      UNION ALL SELECT document_id, obligee_id, 2, min(obligation_id) FROM corpus_obligations GROUP BY document_id, obligee_id""",
)
def bfs_levels(spark, sf_dir):
    m = model(spark, sf_dir)
    start = m.obligations.select("document_id", F.col("obligor_party_id").alias("id")).distinct()
    return R.reach(_owes(m).unionByName(_owed(m)), start, 2)


@query(
    "clusters_topk", "R14",
    DUTIES + f""", {_NODES}, g AS (SELECT document_id, obligor_id AS id, count(*) AS degree FROM corpus_obligations GROUP BY ALL UNION ALL SELECT document_id, obligation_id, 1 FROM corpus_obligations),
      r AS (SELECT n.*, coalesce(degree, 0) AS degree, CAST(row_number() OVER (PARTITION BY document_id, entity_type ORDER BY coalesce(degree, 0) DESC, label, id) AS INT) AS place, greatest(count(*) OVER (PARTITION BY document_id, entity_type) - 3, 0) AS hidden FROM nodes n LEFT JOIN g USING (document_id, id))
      SELECT document_id, entity_type, id, degree, place, hidden FROM r WHERE place <= 3""",
)
def clusters_topk(spark, sf_dir):
    m = model(spark, sf_dir)
    return R.clusters(_nodes(m), _owes(m), most=3).select("document_id", "entity_type", "id", "degree", "place", "hidden")


@query(
    "shortest_path", "R7",
    DUTIES + """, people AS MATERIALIZED (SELECT * FROM corpus_parties), duties AS MATERIALIZED (SELECT document_id, obligee_id, min(obligation_id) AS via FROM corpus_obligations GROUP BY ALL)
      SELECT c.document_id, c.party_id AS a, s.party_id AS b, CASE WHEN o.via IS NOT NULL THEN concat_ws('>', c.party_id, o.via, s.party_id) END AS path FROM people c JOIN people s ON s.document_id = c.document_id AND s.role = 'supplier'
      LEFT JOIN duties o ON o.document_id = c.document_id AND o.obligee_id = s.party_id WHERE c.role = 'customer'""",
)
def shortest_path(spark, sf_dir):
    m = model(spark, sf_dir, dealt=True)
    side = lambda role, name: m.parties.where(F.col("role") == role).select("document_id", F.col("id").alias(name))
    found = R.shortest_paths(_owes(m).unionByName(_owed(m)), side("customer", "a").join(side("supplier", "b"), "document_id"), most=2)
    return found.select("document_id", "a", "b", F.array_join("path", ">").alias("path"))


@query("edge_semantics", "R18", DUTIES + f""", {_DERIVED} SELECT document_id, CASE WHEN type IN ('document-has-party', 'document-has-clause') THEN 'structure' WHEN type IN ('clause-sets-deadline', 'obligation-has-deadline') THEN 'time' ELSE 'duties' END AS about, count(*) AS n FROM derived GROUP BY ALL""")
def edge_semantics(spark, sf_dir):
    m = model(spark, sf_dir)
    e = R.derive_edges(m.clauses, m.parties, m.obligations, m.rights, m.deadlines)
    return e.groupBy("document_id", R.semantics(F.col("type")).alias("about")).agg(F.count("*").alias("n"))


# --- versions ----------------------------------------------------------------------------------


def _versions(spark, sf_dir, renamed: bool = False):
    a, b = corpus(spark, sf_dir, "corpus_a", "corpus_b")
    new = F.when(F.col("ord") % 6 == 0, F.concat(F.lit("n"), "clause_id")).otherwise(F.col("clause_id")) if renamed else F.col("clause_id")
    return a.withColumn("id", F.col("clause_id")), b.withColumn("id", new)


@query(
    "match_entities", "D1 D2 D4",
    ctes("corpus_b") + """, b AS (SELECT *, CASE WHEN ord % 6 = 0 THEN concat('n', clause_id) ELSE clause_id END AS id FROM corpus_b), same AS (SELECT a.document_id, a.clause_id AS id_a, b.id AS id_b FROM corpus_a a JOIN b ON b.document_id = a.document_id AND b.id = a.clause_id),
      oa AS (SELECT *, count(*) OVER (PARTITION BY document_id, lower(text)) AS n FROM corpus_a WHERE clause_id NOT IN (SELECT id_a FROM same)), ob AS (SELECT *, count(*) OVER (PARTITION BY document_id, lower(text)) AS n FROM b WHERE id NOT IN (SELECT id_b FROM same)),
      k AS (SELECT oa.document_id, oa.clause_id AS id_a, ob.id AS id_b FROM oa JOIN ob ON ob.document_id = oa.document_id AND lower(ob.text) = lower(oa.text) WHERE oa.n = 1 AND ob.n = 1)
      SELECT * FROM same UNION ALL SELECT * FROM k UNION ALL SELECT document_id, clause_id, NULL FROM oa WHERE clause_id NOT IN (SELECT id_a FROM k) UNION ALL SELECT document_id, NULL, id FROM ob WHERE id NOT IN (SELECT id_b FROM k)""",
)
def match_entities(spark, sf_dir):
    a, b = _versions(spark, sf_dir, renamed=True)
    return M.match(a, b, M.canonical(F.col("text")), ["text"]).select("document_id", "id_a", "id_b")


@query("field_changes", "D3", ctes("corpus_b") + "SELECT a.document_id, a.clause_id, 'text' AS field, a.text AS before, b.text AS after FROM corpus_a a JOIN corpus_b b ON b.clause_id = a.clause_id WHERE a.l_suppkey % 7 = 0")
def field_changes(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    m = M.match(a, b, M.canonical(F.col("text")), ["number", "heading", "text"])
    return M.field_changes(m, ["number", "heading", "text"]).select("document_id", F.col("id_a").alias("clause_id"), "field", "before", "after")


_KINDS = "kinds AS (SELECT document_id, clause_id, n_days, CASE WHEN l_linenumber = 3 THEN 'removed' WHEN l_suppkey % 7 = 0 THEN 'modified' ELSE 'unchanged' END AS change FROM corpus_a)"


def _kinds(spark, sf_dir, m=None):
    a, b = (t.withColumn("id", F.col("clause_id")) for t in (m.a, m.b)) if m else _versions(spark, sf_dir)
    keep = ["heading", "text", "n_days"]
    return M.classify(M.match(a, b, F.lit(""), keep), ["heading", "text"])


@query("change_kinds", "D5", ctes("corpus_a") + f", {_KINDS} SELECT document_id, clause_id, change FROM kinds")
def change_kinds(spark, sf_dir):
    return _kinds(spark, sf_dir).select("document_id", F.col("id_a").alias("clause_id"), "change")


@query(
    "change_counts", "D13",
    ctes("corpus_a") + f", {_KINDS} SELECT document_id, 'clause' AS scope, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'unchanged') AS unchanged FROM kinds GROUP BY document_id",
)
def change_counts(spark, sf_dir):
    return M.count_changes(_kinds(spark, sf_dir).withColumn("scope", F.lit("clause")), ["clause"], ["document_id"])


@query("period_changes", "D8", ctes("corpus_a") + f", {_KINDS} SELECT document_id, clause_id, CASE change WHEN 'removed' THEN 'dropped' WHEN 'modified' THEN 'extended' ELSE 'same' END AS direction FROM kinds")
def period_changes(spark, sf_dir):
    return _kinds(spark, sf_dir).select("document_id", F.col("id_a").alias("clause_id"), M.period_change(F.col("n_days_a"), F.col("n_days_b")).alias("direction"))


@query(
    "risk_shift", "D14 D15",
    ctes("corpus_a") + f""", {_KINDS} SELECT document_id, CASE WHEN n > 0 THEN 'deadlines-extended' ELSE 'neutral' END AS signal, n FROM (SELECT document_id, count(*) FILTER (change = 'modified') AS n FROM kinds GROUP BY document_id) z""",
)
def risk_shift(spark, sf_dir):
    rows = _kinds(spark, sf_dir).select("document_id", F.lit("deadline").alias("scope"), "change", M.period_change(F.col("n_days_a"), F.col("n_days_b")).alias("direction"))
    return M.risk_shift(rows)


@query(
    "relationship_changes", "D6 D17",
    ctes("corpus_b") + """, ea AS (SELECT DISTINCT document_id, concat('s', l_suppkey) AS t FROM corpus_a), eb AS (SELECT DISTINCT document_id, concat('s', CASE WHEN l_suppkey % 7 = 0 THEN l_suppkey + 1 ELSE l_suppkey END) AS t FROM corpus_b),
      ra AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY t) AS p FROM (SELECT * FROM ea EXCEPT SELECT * FROM eb) x), rb AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY t) AS p FROM (SELECT * FROM eb EXCEPT SELECT * FROM ea) x)
      SELECT document_id, ra.t AS to_a, rb.t AS to_b, CASE WHEN ra.t IS NULL THEN 'added' WHEN rb.t IS NULL THEN 'removed' ELSE 'changed' END AS change FROM ra FULL JOIN rb USING (document_id, p)""",
)
def relationship_changes(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    edges = lambda t, key: t.select("document_id", F.lit("document-has-party").alias("type"), F.col("document_id").cast("string").alias("from_id"), F.concat(F.lit("s"), key.cast("string")).alias("to_id"))
    moved = F.when(F.col("l_suppkey") % 7 == 0, F.col("l_suppkey") + 1).otherwise(F.col("l_suppkey"))
    return M.edge_changes(edges(a, F.col("l_suppkey")), edges(b, moved)).select("document_id", "to_a", "to_b", "change")


@query("structure_changes", "D11 D12", ctes("corpus_a") + f", {_KINDS} SELECT document_id, clause_id AS subject, change FROM kinds")
def structure_changes(spark, sf_dir):
    a, b = _versions(spark, sf_dir)
    facts = lambda t: t.select("document_id", F.lit("clause").alias("kind"), F.col("clause_id").alias("subject"), "ord", F.col("text").alias("value"))
    return M.structure_changes(facts(a), facts(b)).select("document_id", "subject", "change")


@query("graph_diff", "D16 D19", ctes("corpus_a") + f", {_KINDS} SELECT document_id, clause_id, CASE change WHEN 'modified' THEN 'changed' ELSE change END AS change FROM kinds")
def graph_diff(spark, sf_dir):
    nodes = lambda t: t.select("document_id", "id", F.lit("clause").alias("entity_type"), F.col("heading").alias("label"), "text")
    a, b = _versions(spark, sf_dir)
    return M.node_changes(nodes(a), nodes(b), ["text"]).select("document_id", F.col("id_a").alias("clause_id"), "change")


@query("word_diff", "D9 D10")
def word_diff(spark, sf_dir):
    changed = _kinds(spark, sf_dir).where("change = 'modified'")
    return M.word_diff(changed.select("document_id", "id_a", "text_a", "text_b"), "text_a", "text_b")


@query(
    "impact_reach", "M1 M2 M3 M4",
    DUTIES + """, c AS (SELECT document_id, clause_id FROM corpus_a WHERE l_suppkey % 7 = 0) SELECT document_id, clause_id AS source, clause_id AS id, 0 AS distance FROM c
      UNION ALL SELECT c.document_id, c.clause_id, o.obligation_id, 1 FROM c JOIN corpus_obligations o ON o.clause_id = c.clause_id
      UNION ALL SELECT c.document_id, c.clause_id, o.deadline_id, 2 FROM c JOIN corpus_obligations o ON o.clause_id = c.clause_id WHERE o.deadline_id IS NOT NULL""",
)
def impact_reach(spark, sf_dir):
    m = model(spark, sf_dir)
    changed = m.a.where("l_suppkey % 7 = 0").select("document_id", F.col("clause_id").alias("id"))
    links = M.links([(m.obligations, "clause_id", "id", "imposes"), (m.obligations, "id", "deadline_id", "due")])
    return M.impact(changed, links, levels=2).select("document_id", "source", "id", "distance")


# --- questions ---------------------------------------------------------------------------------

_QUESTIONS = [(1, "When must the customer pay invoices?", ["customer", "pay", "invoices"]), (2, "Which notice ends the agreement before expiry?", ["notice", "ends", "agreement", "expiry"]), (3, "What is it?", [])]
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query(
    "ask_tokens", "A1",
    rf"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.\s''-]', ' ', 'g'), '\s+'), lambda x: regexp_replace(x, '^[.''-]+|[.''-]+$', '', 'g')), lambda x: length(x) > 1 AND x NOT IN ({_STOP})), ' ') AS terms FROM conversations""",
)
def ask_tokens(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.array_join(question_terms(F.col("text")), " ").alias("terms"))


def _sql_score(x: str, terms: list[str]) -> str:
    return "(" + (" + ".join(f"CASE WHEN contains(lower({x}), '{t}') THEN {3 if len(t) >= 6 else 2} ELSE 0 END" for t in terms) or "0") + ")"


_RANKED = "ranked AS (" + " UNION ALL ".join(
    f"SELECT document_id, {i} AS question_id, clause_id, ord, {_sql_score('text', t)} + 2 * {_sql_score('heading', t)} + 4 * {_sql_score('number', t)} AS score FROM corpus_a WHERE " + " OR ".join(f"contains(lower(concat_ws(' ', number, heading, text)), '{x}')" for x in t)
    for i, _, t in _QUESTIONS if t
) + "), top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY document_id, question_id ORDER BY score DESC, ord) AS INT) AS place FROM ranked) x WHERE place <= 5)"


def _asked(spark):
    return spark.createDataFrame([(i, q) for i, q, _ in _QUESTIONS], "question_id int, question string")


@query("ask_topk", "A2 A3 A4", ctes("corpus_a") + f", {_RANKED} SELECT document_id, question_id, place, clause_id, score FROM top")
def ask_topk(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return A.retrieve(a, _asked(spark)).select("document_id", "question_id", "place", "clause_id", "score")


def _paragraphs(spark, sf_dir):
    """Documents with their lines as clauses, numbered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("ord", "text"))
    return docs.where("text <> ''").select("document_id", "ord", F.concat_ws("-", F.col("document_id").cast("string"), F.col("ord").cast("string")).alias("clause_id"), F.concat(F.col("ord").cast("string"), F.lit(".1")).alias("number"), F.lit(None).cast("string").alias("heading"), "text")


def _user_questions(spark, sf_dir):
    """What users ask in conversations, each asked of the documents whose id, modulo 100, is the conversation's."""
    said = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("question_id"), F.col("text").alias("question"), question_terms(F.col("text")).alias("terms"), (F.col("conv_id") % 100).alias("c"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), (F.col("doc_id") % 100).alias("c"))
    return said.join(docs, "c").select("question_id", "document_id", "question", "terms")


_USER_TOP = rf"""WITH p AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS ord FROM documents),
    t AS (SELECT concat(conv_id, '/', turn) AS question_id, conv_id % 100 AS c, list_filter(list_transform(string_split_regex(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9.\s''-]', ' ', 'g'), '\s+'), lambda x: regexp_replace(x, '^[.''-]+|[.''-]+$', '', 'g')), lambda x: length(x) > 1 AND x NOT IN ({_STOP})) AS terms FROM conversations WHERE role = 'user'),
    u AS (SELECT question_id, c, unnest(terms) AS term, generate_subscripts(terms, 1) AS pos FROM t),
    s AS (SELECT document_id, question_id, ord, CAST(sum((CASE WHEN contains(lower(text), term) THEN 1 ELSE 0 END + CASE WHEN contains(concat(ord, '.1'), term) THEN 4 ELSE 0 END) * CASE WHEN length(term) >= 6 THEN 3 ELSE 2 END) AS INT) AS score,
      list(term ORDER BY pos) FILTER (contains(lower(concat_ws(' ', concat(ord, '.1'), text)), term)) AS matched FROM p JOIN u ON p.document_id % 100 = u.c WHERE text <> '' GROUP BY ALL),
    top AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id, question_id ORDER BY score DESC, ord) AS INT) AS place FROM s WHERE score > 0)"""


@query("ask_conversations", "A1 A2 A3", f"{_USER_TOP} SELECT document_id, question_id, place, concat(document_id, '-', ord) AS clause_id, score, array_to_string(matched, ' ') AS matched FROM top WHERE place <= 5")
def ask_conversations(spark, sf_dir):
    """The questions of all users, each in its documents."""
    return A.retrieve(_paragraphs(spark, sf_dir), _user_questions(spark, sf_dir)).select("document_id", "question_id", "place", "clause_id", "score", F.array_join("matched", " ").alias("matched"))


@query(
    "ask_excerpts", "A3 A10",
    f"""{_USER_TOP}, e AS (SELECT top.document_id, question_id, place, left(p.text, 4000) AS text FROM top JOIN p ON p.document_id = top.document_id AND p.ord = top.ord WHERE place <= 3),
    r AS (SELECT *, 12000 - coalesce(sum(length(text)) OVER (PARTITION BY document_id, question_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS room FROM e)
    SELECT document_id, question_id, place, md5(left(text, CAST(room AS BIGINT))) AS digest FROM r WHERE room > 0""",
)
def ask_excerpts(spark, sf_dir):
    clauses = _paragraphs(spark, sf_dir)
    return A.excerpts(A.retrieve(clauses, _user_questions(spark, sf_dir), most=3), clauses).select("document_id", "question_id", "place", F.md5("text").alias("digest"))


@query(
    "ask_confidence", "A5 A6 A8",
    ctes("corpus_a") + f""", {_RANKED}, best AS (SELECT document_id, question_id, max(score) AS s FROM top GROUP BY ALL), grid AS (SELECT DISTINCT document_id, q AS question_id FROM corpus_a, (VALUES (1), (2), (3)) v(q))
      SELECT document_id, question_id, CASE WHEN s IS NULL THEN CASE question_id WHEN 3 THEN 'no-terms' ELSE 'no-match' END END AS empty_reason, CASE WHEN s IS NULL THEN 'none' WHEN s >= 8 THEN 'high' WHEN s >= 4 THEN 'medium' ELSE 'low' END AS confidence FROM grid LEFT JOIN best USING (document_id, question_id)""",
)
def ask_confidence(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return A.answer(a, _content(a), _asked(spark)).select("document_id", "question_id", "empty_reason", "confidence")


@query("citation_check", "A7", ctes("corpus_a") + "SELECT document_id, clause_id, CASE ord % 3 WHEN 0 THEN 'unknown-clause' ELSE 'verified' END AS citation_status FROM (SELECT document_id, ord, CASE WHEN ord % 3 = 0 THEN concat('x', clause_id) ELSE clause_id END AS clause_id FROM corpus_a) z")
def citation_check(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    cited = a.select("document_id", F.when(F.col("ord") % 3 == 0, F.concat(F.lit("x"), "clause_id")).otherwise(F.col("clause_id")).alias("clause_id"))
    return A.check_citations(cited, a, _content(a)).select("document_id", "clause_id", "citation_status")


@query(
    "prose_check", "A11 A12 A13",
    ctes("corpus_a") + """SELECT document_id, clause_id, CASE WHEN ord % 4 = 0 THEN 'empty' WHEN ord % 4 = 1 THEN 'no-citation' WHEN NOT EXISTS (SELECT 1 FROM corpus_a n WHERE n.document_id = a.document_id AND n.number = concat(a.l_linenumber, '.1')) THEN 'unknown-number'
      WHEN a.l_linenumber <> 1 THEN 'out-of-scope' END AS withheld FROM corpus_a a""",
)
def prose_check(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    prose = F.when(F.col("ord") % 4 == 0, " ").when(F.col("ord") % 4 == 1, "Nobody knows.").otherwise(F.concat(F.lit("See clause "), F.col("l_linenumber").cast("string"), F.lit(".1")))
    answers = a.select("document_id", "clause_id", F.lit(1).alias("question_id"), prose.alias("prose"), F.array(F.lit("1.1")).alias("in_scope"))
    return A.check_prose(answers, a).select("document_id", "clause_id", "withheld")


@query("clause_search", "S14", ctes("corpus_a") + "SELECT document_id, clause_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY ord) AS INT) AS place FROM corpus_a WHERE contains(lower(text), 'notice')) z WHERE place <= 4")
def clause_search(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return search_clauses(a, "NOTICE").select("document_id", "clause_id", "place")


# --- review, validation, drafts, views ---------------------------------------------------------


@query(
    "checklist", "P1",
    DUTIES + f""", {SIGNALS}, {INCONSISTENCIES}, {_QUOTES}, {_GOOD} SELECT document_id, CASE WHEN status = 'unknown' AND deadline_found THEN 'undated-deadline' WHEN status = 'unknown' THEN 'undated-duty' ELSE status END AS kind, CASE status WHEN 'overdue' THEN 'high' ELSE 'medium' END AS severity, obligation_id AS item_id FROM assessed WHERE status IN ('overdue', 'due', 'unknown')
      UNION ALL SELECT document_id, 'risk', severity, finding_id FROM signals WHERE severity = 'medium'
      UNION ALL SELECT document_id, 'inconsistency', severity, finding_id FROM inconsistencies
      UNION ALL SELECT document_id, 'evidence', 'low', 'evidence' FROM facts GROUP BY document_id HAVING count(*) FILTER (status = 'verified') < count(*)""",
)
def checklist(spark, sf_dir):
    duties, found, m = judged(spark, sf_dir)
    covered = V.coverage(V.collect_facts({"obligation": m.obligations}), quotes(spark, sf_dir, m))
    items = P.checklist(duties, found, inconsistencies(spark, sf_dir, m), covered)
    return items.select("document_id", "kind", "severity", "item_id")


@query(
    "checklist_text", "P2",
    DUTIES + f""", {SIGNALS}, items AS (SELECT a.document_id, CASE WHEN status = 'unknown' AND deadline_found THEN 'undated-deadline' WHEN status = 'unknown' THEN 'undated-duty' ELSE status END AS kind, CASE status WHEN 'overdue' THEN 'high' ELSE 'medium' END AS severity, a.obligation_id AS item_id,
      concat(CASE WHEN status = 'overdue' THEN 'Overdue: ' WHEN status = 'due' THEN 'Due soon: ' WHEN deadline_found THEN 'Deadline without date: ' ELSE 'Duty without timing: ' END, {sql_cut('o.summary', 80)}) AS words FROM assessed a JOIN corpus_obligations o ON o.obligation_id = a.obligation_id WHERE status IN ('overdue', 'due', 'unknown')
      UNION ALL SELECT document_id, 'risk', severity, finding_id, title FROM signals WHERE severity = 'medium')
      SELECT document_id, md5(string_agg(concat('[ ] ', severity, ': ', words), chr(10) ORDER BY severity, list_position(['overdue', 'due', 'undated-deadline', 'undated-duty', 'risk'], kind), item_id)) AS digest FROM items GROUP BY document_id""",
)
def checklist_text(spark, sf_dir):
    duties, found, _ = judged(spark, sf_dir)
    return P.as_text(P.checklist(duties, found, None, dealt=True)).select("document_id", F.md5("text").alias("digest"))


@query("prep_plan", "P3 P4 P5 P6 P7")
def prep_plan(spark, sf_dir):
    duties, found, m = judged(spark, sf_dir)
    # Several sections read both: they are made once, in one run over the lines.
    duties = duties.select("document_id", "id", "summary", "status", "deadline_found", "obligor_party_id").withColumn("made", F.lit("duty"))
    made = written(found.drop("category", "entity_id").withColumn("made", F.lit("finding")).unionByName(duties, allowMissingColumns=True), "judged", "made")
    found, duties = (made.where(F.col("made") == k) for k in ("finding", "duty"))
    changes = _kinds(spark, sf_dir, m).select("document_id", F.col("id_a").alias("id"), F.lit("clause").alias("scope"), "change").where("change <> 'unchanged'")
    changes = written(changes, "changes")
    links = M.links([(m.obligations, "clause_id", "id", "imposes"), (m.rights, "clause_id", "id", "grants"), (m.deadlines, "clause_id", "id", "sets"), (m.conditions, "clause_id", "id", "states")])
    return P.plan([P.questions(duties, found), P.facts(m.parties, duties), P.clauses_to_read(found), P.changes_to_read(changes, M.impact(changes.select("document_id", "id"), links, levels=1))])


@query(
    "validate_issues", "L1 L2 L4 L5 L6",
    DUTIES + """SELECT document_id, 'missing-deadline_id' AS code, 'error' AS severity, obligation_id AS entity_id FROM corpus_obligations WHERE deadline_id IS NULL
      UNION ALL SELECT document_id, 'unknown-date_type', 'warning', deadline_id FROM corpus_deadlines WHERE date_type = 'unspecified'
      UNION ALL SELECT document_id, 'duplicate-id', 'error', obligation_id FROM corpus_obligations WHERE ord % 3 = 0
      UNION ALL SELECT document_id, 'dangling-reference', 'error', obligation_id FROM corpus_obligations WHERE ord % 4 = 0 UNION ALL SELECT document_id, 'wrong-reference-type', 'error', obligation_id FROM corpus_obligations WHERE ord % 4 = 1""",
)
def validate_issues(spark, sf_dir):
    m = model(spark, sf_dir)
    n = F.col("ord") % 4
    index = U.index({"obligation": m.obligations, "party": m.parties})
    twice = index.where("entity_type = 'obligation'").unionByName(m.obligations.where("ord % 3 = 0").select("document_id", "id", F.lit("obligation").alias("entity_type")))
    keys = m.obligations.withColumn("target", F.when(n == 0, "lost").when(n == 1, F.col("id")).otherwise(F.col("obligor_party_id")))
    parts = [L.required(m.obligations, ["summary", "deadline_id"]), L.vocabulary(m.deadlines, "date_type", ["fixed", "relative"]), L.duplicates(twice), L.references(L.foreign_keys([(keys, "target", "party")]), index)]
    return L.report(parts).select(*L.ISSUE)


@query("validate_summary", "L6", ctes("corpus_obligations", "corpus_deadlines") + """, i AS (SELECT document_id, 1 AS e, 0 AS w FROM corpus_obligations WHERE deadline_id IS NULL UNION ALL SELECT document_id, 0, 1 FROM corpus_deadlines WHERE date_type = 'unspecified')
    SELECT d.document_id, CAST(coalesce(sum(e), 0) AS BIGINT) AS errors, CAST(coalesce(sum(w), 0) AS BIGINT) AS warnings, coalesce(sum(e), 0) = 0 AS valid FROM (SELECT DISTINCT document_id FROM corpus_a) d LEFT JOIN i ON i.document_id = d.document_id GROUP BY d.document_id""")
def validate_summary(spark, sf_dir):
    m = model(spark, sf_dir)
    parts = [L.required(m.obligations, ["summary", "deadline_id"]), L.vocabulary(m.deadlines, "date_type", ["fixed", "relative"])]
    return L.summary(L.report(parts), m.clauses)


@query("validate_edges", "L3", DUTIES + "SELECT document_id, 'edge-unknown-endpoint' AS code, CAST(ord AS VARCHAR) AS entity_id FROM corpus_obligations WHERE ord % 5 = 0")
def validate_edges(spark, sf_dir):
    m = model(spark, sf_dir)
    e = _owes(m).withColumn("to_id", F.when(F.col("ord") % 5 == 0, "lost").otherwise(F.col("to_id")))
    return L.relationships(e, _nodes(m)).select("document_id", "code", "entity_id")


@query("dedupe_first", "X11", "SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS r FROM events) z WHERE r = 1")
def dedupe_first(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts")
    return X.first_of_each(e, F.col("event_type"), ["ts", "event_id"], by="user_id").select("event_id", "user_id", "event_type")


@query(
    "draft_parse", "X5 X6 X7 X8 X9 X10",
    "SELECT event_id AS document_id, CASE event_id % 3 WHEN 0 THEN 'ok' WHEN 1 THEN 'repaired' ELSE 'failed' END AS parse_status, CASE WHEN event_id % 3 < 2 THEN event_type END AS name FROM events",
)
def draft_parse(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("document_id"), "event_type")
    body = F.concat(F.lit('```json {"parties": [{"name": " '), "event_type", F.when(F.col("document_id") % 3 == 0, '"}]} ```').otherwise('",}]} ```'))
    p = X.parse(e.select("document_id", F.lit(0).alias("chunk"), F.when(F.col("document_id") % 3 == 2, "no answer").otherwise(body).alias("reply")))
    return p.select("document_id", "parse_status").join(X.drafts(p, "parties").select("document_id", "name"), "document_id", "left")


@query("unique_ids", "X15", ctes("corpus_a") + "SELECT document_id, ord, CASE WHEN n = 1 THEN heading ELSE concat(heading, '_', n) END AS id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, heading ORDER BY ord) AS n FROM corpus_a) z")
def unique_ids(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return X.unique_ids(a.select("document_id", "ord", F.col("heading").alias("id")), ["ord"])


@query("hinted_types", "X12", ctes("corpus_a") + f"SELECT document_id, clause_id, CASE WHEN t = 'other' THEN 'hinted' ELSE t END AS clause_type FROM (SELECT *, {sql_clause_type('number', 'text')} AS t FROM corpus_a) z")
def hinted_types(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    from ..operators.clauses import classify

    typed = classify(a.withColumn("heading", F.lit(None).cast("string")))
    return X.apply_hints(typed, a.select("document_id", "number", F.lit("hinted").alias("clause_type"))).select("document_id", "clause_id", "clause_type")


@query("state_fold", "U3 U4", "SELECT user_id, last(event_id ORDER BY event_id) AS seq, last(event_type ORDER BY event_id) AS event_type, min(event_id) AS first_seq, count(*) AS events FROM events GROUP BY user_id")
def state_fold(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("event_id").alias("seq"), "event_type")
    return U.fold(e, ["user_id"])


@query("stage_summary", "U2", "SELECT conv_id, status, count(*) AS stages FROM (SELECT conv_id, role, CASE WHEN max(turn) % 2 = 0 THEN 'done' ELSE 'failed' END AS status FROM conversations GROUP BY ALL) z GROUP BY ALL")
def stage_summary(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    log = c.select("conv_id", F.col("role").alias("stage"), F.col("turn").alias("seq"), F.when(F.col("turn") % 2 == 0, "done").otherwise("failed").alias("status"))
    return U.stage_counts(log, ["conv_id"])


@query(
    "interval_merge", "U9",
    ctes("corpus_a") + """, s AS (SELECT document_id, ord * 10 AS a, ord * 10 + CAST(n_days AS INT) AS b FROM corpus_a), g AS (SELECT *, max(b) OVER (PARTITION BY document_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM s),
      r AS (SELECT *, sum(CASE WHEN m IS NULL OR a > m THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT document_id, min(a) AS start_offset, max(b) AS end_offset FROM r GROUP BY document_id, run""",
)
def interval_merge(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    spans = a.select("document_id", (F.col("ord") * 10).alias("start_offset"), (F.col("ord") * 10 + F.col("n_days").cast("int")).alias("end_offset"))
    return U.merge_intervals(spans, ["document_id"])


@query(
    "workspace_gaps", "U7",
    DUTIES + f", {SIGNALS} SELECT document_id, CASE WHEN deadline_found THEN 'no-date' ELSE 'no-timing' END AS gap, count(*) AS n FROM assessed WHERE status = 'unknown' GROUP BY ALL UNION ALL SELECT document_id, concat('finding-', severity), count(*) FROM signals GROUP BY ALL",
)
def workspace_gaps(spark, sf_dir):
    duties, found, _ = judged(spark, sf_dir)
    return U.gaps(duties, found)


@query(
    "party_rows", "U6",
    DUTIES + "SELECT p.document_id, p.party_id, (SELECT count(*) FROM corpus_obligations o WHERE o.document_id = p.document_id AND o.obligor_id = p.party_id) AS duties, (SELECT count(*) FROM corpus_rights r WHERE r.document_id = p.document_id AND r.holder_id = p.party_id) AS rights FROM corpus_parties p",
)
def party_rows(spark, sf_dir):
    m = model(spark, sf_dir)
    return U.party_rows(m.parties, m.obligations, m.rights).select("document_id", F.col("id").alias("party_id"), "duties", "rights")


@query("type_filters", "U10", ctes("corpus_a") + f""", t AS (SELECT document_id, {sql_clause_type('heading', 'concat(heading, chr(10), text)')} AS clause_type, count(*) AS n FROM corpus_a GROUP BY ALL)
      SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY n DESC, clause_type) AS INT) AS place FROM t""")
def type_filters(spark, sf_dir):
    return U.type_filters(model(spark, sf_dir).clauses)
