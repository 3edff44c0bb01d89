"""Queries over the smaller operators of every family, each with SQL that computes the answer for itself."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import ask as A
from ..operators import clauses as C
from ..operators import compare as M
from ..operators import consistency as I
from ..operators import dictionary as N
from ..operators import drafts as X
from ..operators import evidence as V
from ..operators import graph as R
from ..operators import risk as K
from ..operators import views as U
from ..sources import ingest as S
from .corpus import corpus, ctes
from .model import documents, model
from .queries_duties import _SAID, DUTIES, I1_SQL, SIGNALS, signals, sql_cut
from .queries_model import _DERIVED, _KINDS, _NODES, _kinds, _nodes, _owes
from .queries_text import _LINES, _SPACE, _content, _sql_neutral, sql_clause_type, sql_phrase, sql_sanitize
from .registry import query


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '{_SPACE}+', ' ', 'g'))"


def sql_cut_at_word(x: str, most: int) -> str:
    head = f"substr({x}, 1, {most})"
    at = f"(length({head}) - strpos(reverse({head}), ' '))"
    return f"CASE WHEN length({x}) <= {most} THEN {x} ELSE concat(CASE WHEN strpos({head}, ' ') > 0 AND {at} > {most} * 0.6 THEN substr({head}, 1, {at}) ELSE {head} END, '…') END"


# --- files, pages, texts -----------------------------------------------------------------------


@query("file_facts", "S3", "SELECT page_id, lower(regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1)) AS extension, concat(CAST(round(octet_length(encode(html)) / 1024, 1) AS VARCHAR), ' KB') AS size_label FROM pages")
def file_facts(spark, sf_dir):
    files = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("url").alias("name"), F.octet_length("html").alias("n_bytes"))
    return S.describe(files).select("page_id", "extension", "size_label")


@query(
    "content_gate", "S8",
    "SELECT doc_id AS document_id, CASE WHEN trim(coalesce(text, '')) = '' THEN CASE WHEN doc_id % 2 = 0 THEN 'content.no-text-layer' ELSE 'content.no-text' END WHEN length(text) > 900 THEN 'content.too-long' END AS code FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '  ' ELSE text END AS text FROM documents) d",
)
def content_gate(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("text", F.when(F.col("document_id") % 5 == 0, "  ").otherwise(F.col("text")))
    kind = F.when(F.col("document_id") % 2 == 0, "pdf").otherwise("txt")
    return d.select("document_id", S.content_code(kind, F.col("text"), 900).alias("code"))


_PAGES = "p0 AS (SELECT document_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM lines0), pages0 AS (SELECT document_id, pos + 1 AS page_number, coalesce(sum(length(t) + 2) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS char_start FROM p0)"
_POINTS = "points AS (SELECT doc_id AS document_id, CAST(length(coalesce(text, '')) // 3 AS INT) AS o FROM documents)"


def _points(d):
    return d.select("document_id", F.floor(F.length("text") / 3).cast("int").alias("offset"))


@query("page_of_offset", "S9 S10", f"WITH {_LINES}, {_PAGES}, {_POINTS} SELECT x.document_id, o AS \"offset\", CAST(coalesce(max(page_number) FILTER (char_start <= o), 1) AS INT) AS page FROM points x JOIN pages0 USING (document_id) GROUP BY ALL")
def page_of_offset(spark, sf_dir):
    d = documents(spark, sf_dir)
    return S.page_at(_points(d), S.pages(d.withColumnRenamed("text", "raw"), separator="\n")).select("document_id", "offset", "page")


_PARAGRAPHS = """l0 AS (SELECT *, regexp_matches(line, '\\S') AS f, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lines0),
      m0 AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER (PARTITION BY document_id ORDER BY pos), false) THEN 1 ELSE 0 END AS fresh FROM l0),
      g0 AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY pos) - 1 AS p FROM m0), para AS (SELECT document_id, p, min(s) AS p0, max(s + length(line)) AS p1 FROM g0 WHERE f GROUP BY ALL)"""


@query(
    "locate_offset", "C14 C18 C19",
    f"""WITH {_LINES}, {_PAGES}, {_POINTS}, {_PARAGRAPHS}, inside AS (SELECT document_id, o, min(p) FILTER (o <= p1) AS paragraph, min(p) FILTER (o < p1) AS c FROM points JOIN para USING (document_id) WHERE o >= p0 GROUP BY ALL),
      page AS (SELECT document_id, max(page_number) AS page FROM points JOIN pages0 USING (document_id) WHERE char_start <= o GROUP BY ALL)
      SELECT x.document_id, x.o AS "offset", concat('p', CAST(c AS VARCHAR)) AS clause_id, CAST(paragraph AS BIGINT) AS paragraph, CAST(page AS INT) AS page FROM points x LEFT JOIN inside i ON i.document_id = x.document_id LEFT JOIN page g ON g.document_id = x.document_id""".replace("concat('p', CAST(c AS VARCHAR))", "'p' || CAST(c AS VARCHAR)"),
)
def locate_offset(spark, sf_dir):
    d = documents(spark, sf_dir)
    para = C.paragraphs(d)
    clauses = para.select("document_id", F.concat(F.lit("p"), F.col("paragraph").cast("string")).alias("clause_id"), F.col("paragraph").alias("ord"), "start_offset", "end_offset")
    found = C.locate(_points(d), clauses, para, S.pages(d.withColumnRenamed("text", "raw"), separator="\n"))
    return found.select("document_id", "offset", "clause_id", F.col("paragraph").cast("long").alias("paragraph"), "page")


@query("snippets", "S11", f"SELECT document_id, {sql_cut('s', 40)} AS snippet FROM (SELECT doc_id AS document_id, {sql_collapse('substr(text, 6, 55)')} AS s FROM documents) x")
def snippets(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", S.snippet(F.col("text"), F.lit(5), F.lit(60), 40).alias("snippet"))


@query("cut_words", "N2", f"SELECT doc_id AS document_id, {sql_cut_at_word('text', 40)} AS short FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d")
def cut_words(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", T.cut_at_word(F.col("text"), 40).alias("short"))


@query("log_lines", "N4", r"""SELECT doc_id AS document_id, sha256(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x1F\x7F]', '', 'g'), '(["\\])', '\\\1', 'g')) AS sha FROM documents""")
def log_lines(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.sha2(T.log_escape(F.col("text")), 256).alias("sha"))


@query("fence", "N10", f"SELECT doc_id AS document_id, sha256(concat_ws(chr(10), 'Doc:', '{T.FENCE}', replace({_sql_neutral('text')}, '{T.FENCE}', '<< <fence> >>'), '{T.FENCE}')) AS sha FROM (SELECT doc_id, substr(coalesce(text, ''), 1, 400) AS text FROM documents) d")
def fence(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.sha2(T.fenced(F.col("text"), "Doc", 400), 256).alias("sha"))


@query("safe_questions", "N11", f"SELECT conv_id, turn, {sql_cut_at_word('q', 60)} AS asked FROM (SELECT conv_id, turn, {sql_collapse(_sql_neutral(sql_sanitize('text')))} AS q FROM conversations) c")
def safe_questions(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", T.clean_question(F.col("text"), 60).alias("asked"))


@query(
    "document_ids", "S13",
    """SELECT doc_id AS document_id, lower(to_base(list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(k, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: xor((a * 33) % 4294967296, c)), 36)) AS fingerprint
      FROM (SELECT doc_id, concat_ws('|', CAST(doc_id AS VARCHAR), CAST(length(coalesce(text, '')) AS VARCHAR), substr(coalesce(text, ''), 1, 512)) AS k FROM documents) d""",
)
def document_ids(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", S.fingerprint(F.col("document_id"), F.col("text")).alias("fingerprint"))


# --- clauses and chunks ------------------------------------------------------------------------

_CHUNKS = """placed AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS s0, length(text) AS n FROM corpus_a),
      walk AS (SELECT document_id, ord, clause_id, s0, s0 + n AS e0, 0 AS chunk, s0 AS c0 FROM placed WHERE ord = 1
        UNION ALL SELECT p.document_id, p.ord, p.clause_id, p.s0, p.s0 + p.n, CASE WHEN p.s0 + p.n - w.c0 <= 200 THEN w.chunk ELSE w.chunk + 1 END, CASE WHEN p.s0 + p.n - w.c0 <= 200 THEN w.c0 ELSE p.s0 END FROM walk w JOIN placed p ON p.document_id = w.document_id AND p.ord = w.ord + 1),
      chunks AS (SELECT document_id, chunk, min(s0) AS start_offset, CAST(max(e0) AS INT) AS end_offset, string_agg(clause_id, ',' ORDER BY ord) AS ids, arg_max(clause_id, ord) AS last_id FROM walk GROUP BY ALL)"""
_RECURSIVE = ctes("corpus_a").replace("WITH ", "WITH RECURSIVE ", 1)


def _chunks(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    placed = C.with_offsets(a)
    return C.overlap_chunks(C.pack_chunks(placed, most=200)), placed


@query(
    "chunk_pack", "C10 C11",
    _RECURSIVE + f", {_CHUNKS} SELECT document_id, chunk, start_offset, end_offset, ids AS clause_ids, coalesce(lag(last_id) OVER (PARTITION BY document_id ORDER BY chunk), '') AS carried, CAST(ceil((end_offset - start_offset) / 4) AS INT) AS tokens FROM chunks",
)
def chunk_pack(spark, sf_dir):
    chunks, _ = _chunks(spark, sf_dir)
    return chunks.select("document_id", "chunk", "start_offset", "end_offset", F.array_join("clause_ids", ",").alias("clause_ids"), F.array_join("carried_ids", ",").alias("carried"), "tokens")


@query("chunk_summary", "C12", _RECURSIVE + f", {_CHUNKS} SELECT document_id, count(*) AS chunks, CAST(sum(ceil((end_offset - start_offset) / 4)) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS truncated FROM chunks GROUP BY document_id")
def chunk_summary(spark, sf_dir):
    return C.summarize_chunks(_chunks(spark, sf_dir)[0])


@query(
    "chunk_clauses", "C17",
    _RECURSIVE + f""", {_CHUNKS}, inside AS (SELECT c.document_id, c.chunk, p.clause_id FROM chunks c JOIN placed p ON p.document_id = c.document_id AND p.s0 <= c.end_offset AND p.s0 + p.n >= c.start_offset),
      before AS (SELECT document_id, chunk, lag(last_id) OVER (PARTITION BY document_id ORDER BY chunk) AS clause_id FROM chunks)
      SELECT document_id, chunk, clause_id, false AS carried FROM inside UNION ALL SELECT document_id, chunk, clause_id, true FROM before b WHERE clause_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.document_id = b.document_id AND i.chunk = b.chunk AND i.clause_id = b.clause_id)""",
)
def chunk_clauses(spark, sf_dir):
    chunks, placed = _chunks(spark, sf_dir)
    return C.chunk_clauses(chunks, placed).select("document_id", F.col("range_id").alias("chunk"), "clause_id", "carried")


@query("weak_types", "C8", ctes("corpus_a") + f"SELECT document_id, clause_id, t IN ('other', 'unknown') AS weak FROM (SELECT *, {sql_clause_type('number', 'text')} AS t FROM corpus_a) z")
def weak_types(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return C.classify(a.withColumn("heading", F.lit(None).cast("string"))).select("document_id", "clause_id", C.is_weak(F.col("clause_type")).alias("weak"))


# --- evidence ----------------------------------------------------------------------------------

_BODY = "body AS (SELECT document_id, string_agg(concat(number, ' ', heading, chr(10), text), chr(10) ORDER BY ord) AS t FROM corpus_a GROUP BY document_id)"


@query("source_places", "V10", ctes("corpus_a") + f", {_BODY} SELECT a.document_id, a.clause_id, CAST(CASE WHEN ord % 3 = 0 THEN ord ELSE strpos(t, CASE WHEN ord % 3 = 1 THEN text ELSE upper(text) END) - 1 END AS INT) AS \"offset\" FROM corpus_a a JOIN body USING (document_id)")
def source_places(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    n = F.col("ord") % 3
    quotes = a.select("document_id", "clause_id", F.when(n == 1, F.col("text")).otherwise(F.upper("text")).alias("source_text"), F.when(n == 0, F.col("ord")).alias("start_offset"))
    return V.source_offset(quotes, _content(a)).select("document_id", "clause_id", F.col("offset").cast("int").alias("offset"))


@query("quote_places", "V2 V10", ctes("corpus_a") + f", {_BODY} SELECT a.document_id, a.clause_id, CAST(CASE WHEN ord % 4 = 3 THEN -1 ELSE strpos(t, text) - 1 END AS INT) AS start_offset, CAST(CASE WHEN ord % 4 = 3 THEN -1 ELSE strpos(t, text) - 1 + length(text) END AS INT) AS end_offset FROM corpus_a a JOIN body USING (document_id)")
def quote_places(spark, sf_dir):
    """Quotes in capitals, with wide spaces and line ends, with invisible characters, and some that do not stand."""
    (a,) = corpus(spark, sf_dir, "corpus_a")
    n = F.col("ord") % 4
    quote = F.when(n == 0, F.upper("text")).when(n == 1, F.concat(F.lit(" \u2003"), F.replace("text", F.lit(" "), F.lit("\u00a0\n ")))).when(n == 2, F.replace("text", F.lit("i"), F.lit("\u200bi"))).otherwise(F.concat("text", F.lit(" not")))
    return V.quote_places(a.select("document_id", "clause_id", quote.alias("source_text")), _content(a), "clause_id")


@query("citations", "V11", ctes("corpus_a") + "SELECT document_id, clause_id, CASE WHEN ord % 2 = 0 THEN concat('§', number) ELSE concat('§', number, ' · p. ', ord) END AS citation FROM corpus_a")
def citations(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return a.select("document_id", "clause_id", V.citation(F.col("number"), F.when(F.col("ord") % 2 == 1, F.col("ord"))).alias("citation"))


@query(
    "evidence_ranges", "V2",
    ctes("corpus_a") + f""", {_BODY}, q AS (SELECT a.document_id, a.clause_id, a.ord, a.text, t, strpos(t, text) - 1 AS p, length(t) AS whole FROM corpus_a a JOIN body USING (document_id)),
      r AS (SELECT *, CASE ord % 5 WHEN 1 THEN whole - 3 WHEN 2 THEN -1 WHEN 4 THEN 0 ELSE p END AS s, CASE ord % 5 WHEN 1 THEN whole + 3 WHEN 4 THEN 3 ELSE p + length(text) END AS e FROM q)
      SELECT document_id, clause_id, CASE WHEN ord % 5 = 3 THEN 'unknown-clause' WHEN s < 0 OR e <= s OR e > whole THEN 'invalid-range'
        WHEN contains(lower(substr(t, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT))), lower(text)) OR contains(lower(t), lower(text)) THEN 'verified' ELSE 'text-mismatch' END AS status FROM r""",
)
def evidence_ranges(spark, sf_dir):
    """Right ranges, ranges beyond the text or before it, ranges of other words, and a page that the document lacks."""
    (a,) = corpus(spark, sf_dir, "corpus_a")
    content = _content(a)
    n = F.col("ord") % 5
    x = a.join(content.select("document_id", F.col("text").alias("t")), "document_id").withColumn("at", F.expr("position(text in t) - 1")).withColumn("whole", F.length("t"))
    start = F.when(n == 1, F.col("whole") - 3).when(n == 2, -1).when(n == 4, 0).otherwise(F.col("at"))
    end = F.when(n == 1, F.col("whole") + 3).when(n == 4, 3).otherwise(F.col("at") + F.length("text"))
    rows = x.select("document_id", "clause_id", F.concat(F.lit("e"), "clause_id").alias("entity_id"), F.lit("obligation").alias("entity_type"), F.col("text").alias("source_text"), F.when(n == 3, 9).otherwise(1).alias("page"), start.cast("int").alias("start_offset"), end.cast("int").alias("end_offset"), F.lit(None).cast("string").alias("id"))
    return V.verify(V.normalize(rows), content.withColumn("page_count", F.lit(1)), a).select("document_id", "clause_id", "status")


@query("evidence_merge", "T8", ctes("corpus_a") + "SELECT document_id, entity_id, min(id) AS id FROM (SELECT document_id, heading AS entity_id, concat('e', ord) AS id, n_days % 3 AS k FROM corpus_a) z GROUP BY document_id, entity_id, k")
def evidence_merge(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    rows = a.select("document_id", F.col("heading").alias("entity_id"), F.lit(None).cast("string").alias("clause_id"), (F.col("n_days") % 3).cast("string").alias("source_text"), F.lit(0).alias("start_offset"), F.concat(F.lit("e"), F.col("ord").cast("string")).alias("id"))
    return V.merge(rows).select("document_id", "entity_id", "id")


@query("facts_by_clause", "V7", ctes("corpus_obligations", "corpus_deadlines") + "SELECT document_id, clause_id, string_agg(id, ',' ORDER BY id) AS fact_ids FROM (SELECT document_id, clause_id, obligation_id AS id FROM corpus_obligations UNION ALL SELECT document_id, clause_id, deadline_id FROM corpus_deadlines) f GROUP BY ALL")
def facts_by_clause(spark, sf_dir):
    m = model(spark, sf_dir)
    return V.by_clause(V.collect_facts({"obligation": m.obligations, "deadline": m.deadlines})).select("document_id", "clause_id", F.array_join("fact_ids", ",").alias("fact_ids"))


# --- graph -------------------------------------------------------------------------------------

# How the edge types of the corpus read, as (type, category, words).
_READS = """reads AS (SELECT * FROM (VALUES
    ('document-has-party', 'structure', 'has party'),
    ('document-has-clause', 'structure', 'has clause'),
    ('clause-imposes-obligation', 'duties', 'imposes obligation'),
    ('clause-grants-right', 'duties', 'grants right'),
    ('clause-sets-deadline', 'time', 'sets deadline'),
    ('party-obligated-by', 'duties', 'is obligated by'),
    ('obligation-owed-to', 'duties', 'is owed to'),
    ('party-holds-right', 'duties', 'holds right'),
    ('right-held-against', 'duties', 'is held against'),
    ('obligation-has-deadline', 'time', 'has deadline'),
    ('risk-about', 'findings', 'about')) v(type, category, words))"""
#: The corpus as a graph with findings: nodes in order, edges, and how often each node is an end.
_VIEW = f"""{_DERIVED}, {_READS}, seen0 AS (SELECT document_id, clause_id AS id, 'clause' AS entity_type, heading AS label, 0 AS k FROM corpus_a UNION ALL SELECT document_id, party_id, 'party', name, 1 FROM corpus_parties
    UNION ALL SELECT document_id, obligation_id, 'obligation', summary, 2 FROM corpus_obligations UNION ALL SELECT document_id, right_id, 'right', summary, 3 FROM corpus_rights UNION ALL SELECT document_id, deadline_id, 'deadline', description, 4 FROM corpus_deadlines
    UNION ALL SELECT document_id, concat('x', clause_id), 'risk', concat('Risk of ', heading), 5 FROM corpus_a WHERE l_suppkey % 5 = 0),
    vnodes AS (SELECT document_id, id, entity_type, label, row_number() OVER (PARTITION BY document_id ORDER BY k, id) AS place, CASE entity_type WHEN 'risk' THEN 'Risk signal' ELSE concat(upper(entity_type[1]), entity_type[2:]) END AS type_label FROM seen0),
    vedges AS (SELECT document_id, type, from_id, to_id FROM derived WHERE type NOT LIKE 'document%' UNION ALL SELECT document_id, 'risk-about', concat('x', clause_id), clause_id FROM corpus_a WHERE l_suppkey % 5 = 0),
    vends AS (SELECT document_id, from_id AS id, to_id AS other_id, type, '' AS tail FROM vedges UNION ALL SELECT document_id, to_id, from_id, type, ' (incoming)' FROM vedges),
    vdegree AS (SELECT document_id, id, count(*) AS degree FROM vends GROUP BY ALL)"""


def _view(spark, sf_dir, dealt=False):
    m = model(spark, sf_dir, dealt)
    of = lambda t, kind, key, text, k: t.select("document_id", F.col(key).alias("id"), F.lit(kind).alias("entity_type"), F.col(text).alias("label"), F.lit(k).alias("k"))
    risky = m.a.where("l_suppkey % 5 = 0").select("document_id", "clause_id", F.concat(F.lit("x"), "clause_id").alias("id"), F.concat(F.lit("Risk of "), "heading").alias("title"))
    parts = [of(m.clauses, "clause", "clause_id", "heading", 0), of(m.parties, "party", "id", "name", 1), of(m.obligations, "obligation", "id", "summary", 2), of(m.rights, "right", "id", "summary", 3), of(m.deadlines, "deadline", "id", "description", 4), of(risky, "risk", "id", "title", 5)]
    nodes = reduce(lambda x, y: x.unionByName(y), parts).withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("k", "id"))).drop("k")
    edges = R.derive_edges(m.clauses, m.parties, m.obligations, m.rights, m.deadlines, dealt=dealt).where("type not like 'document%'")
    return nodes, edges.unionByName(R.edge(risky, "risk-about", "id", "risk", "clause_id", "clause"))


@query("edge_words", "R12 R18", DUTIES + f", {_VIEW} SELECT type, category, words AS label, count(*) AS n FROM vedges JOIN reads USING (type) GROUP BY ALL")
def edge_words(spark, sf_dir):
    """How the edges of the corpus read, with counts."""
    _, edges = _view(spark, sf_dir)
    return edges.groupBy("type").agg(F.count("*").alias("n")).select("type", R.semantics(F.col("type")).alias("category"), R.label(F.col("type")).alias("label"), "n")


@query("graph_groups", "R13", DUTIES + f", {_VIEW} SELECT document_id, count(*) AS n FROM vedges e WHERE type IN ('party-obligated-by', 'obligation-owed-to', 'party-holds-right', 'right-held-against') GROUP BY ALL")
def graph_groups(spark, sf_dir):
    """Edges that are left when only parties and duties are switched on."""
    _, edges = R.in_groups(*_view(spark, sf_dir), ["parties", "duties"])
    return edges.groupBy("document_id").agg(F.count("*").alias("n"))


@query("graph_topics", "R17", DUTIES + f""", {_VIEW}, t AS (SELECT *, row_number() OVER (PARTITION BY document_id, entity_type ORDER BY place) AS nth FROM vnodes WHERE entity_type IN ('obligation', 'deadline'))
      SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY entity_type DESC, nth) AS INT) AS topic, id, label, entity_type AS type FROM t WHERE nth <= CASE entity_type WHEN 'obligation' THEN 3 ELSE 2 END""")
def graph_topics(spark, sf_dir):
    return R.topics(_view(spark, sf_dir)[0])


_FOCUS = "vfocus AS (SELECT document_id, min_by(id, rank) AS focus FROM (SELECT n.document_id, n.id, CASE entity_type WHEN 'obligation' THEN 0 WHEN 'right' THEN 1 WHEN 'deadline' THEN 1 ELSE 2 END * 1000000 - CASE WHEN entity_type IN ('obligation', 'right', 'deadline') THEN coalesce(degree, 0) ELSE 0 END * 1000 + place AS rank FROM vnodes n LEFT JOIN vdegree d ON d.document_id = n.document_id AND d.id = n.id) z GROUP BY document_id)"


@query(
    "focused_view", "R8 R13 R17",
    DUTIES + f""", {_VIEW}, {_FOCUS}, shown AS (SELECT document_id, focus AS id, 0 AS depth FROM vfocus UNION SELECT v.document_id, other_id, 1 FROM vfocus f JOIN vends v ON v.document_id = f.document_id AND v.id = f.focus WHERE v.type <> 'risk-about' AND other_id <> focus)
      SELECT s.document_id, s.id, n.label, CAST(depth AS INT) AS depth, coalesce((SELECT string_agg(e.from_id, ',' ORDER BY e.from_id) FROM vedges e WHERE e.document_id = s.document_id AND e.to_id = s.id AND e.type = 'risk-about'), '') AS findings FROM shown s JOIN vnodes n ON n.document_id = s.document_id AND n.id = s.id""",
)
def focused_view(spark, sf_dir):
    shown, _ = R.focused_view(*_view(spark, sf_dir, dealt=True))
    return shown.select("document_id", "id", "label", "depth", F.array_join("findings", ",").alias("findings"))


@query(
    "dictionary_hits", "K15 C5",
    ctes("corpus_a") + """, names AS (SELECT concat('supplier ', s_suppkey) AS name_key FROM supplier UNION SELECT concat(' ', p_size, ' days') FROM part UNION SELECT lower(heading) FROM corpus_a UNION SELECT concat('clause ', l_linenumber, '.1') FROM lineitem)
      SELECT document_id, clause_id, name_key FROM corpus_a JOIN names ON contains(lower(concat_ws(' ', heading, text)), name_key)""",
)
def dictionary_hits(spark, sf_dir):
    """Aliases of all suppliers, periods, headings and references in all clauses, by one automaton."""
    (a,) = corpus(spark, sf_dir, "corpus_a")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    names = [read("supplier").select(F.concat(F.lit("Supplier "), "s_suppkey").alias("name")), read("part").select(F.concat(F.lit(" "), "p_size", F.lit(" days")).alias("name")), a.select(F.col("heading").alias("name")), read("lineitem").select(F.concat(F.lit("Clause "), "l_linenumber", F.lit(".1")).alias("name"))]
    return N.find(a.select("document_id", "clause_id", F.concat_ws(" ", "heading", "text").alias("text")), reduce(lambda x, y: x.unionByName(y), names), ["document_id", "clause_id"])


@query("graph_build", "R4", DUTIES + "SELECT document_id, count(*) FILTER (ord % 5 <> 0) AS whole, count(*) FILTER (ord % 5 = 0) AS broken FROM corpus_obligations GROUP BY document_id")
def graph_build(spark, sf_dir):
    m = model(spark, sf_dir)
    edges = _owes(m).withColumn("to_id", F.when(F.col("ord") % 5 == 0, "lost").otherwise(F.col("to_id")))
    whole, broken = R.build(_nodes(m), edges)
    both = whole.select("document_id", F.lit(1).alias("w")).unionByName(broken.select("document_id", F.lit(0).alias("w")))
    return both.groupBy("document_id").agg(F.sum("w").alias("whole"), F.sum(1 - F.col("w")).alias("broken"))


@query("subgraph", "R8", DUTIES + "SELECT document_id, obligor_id AS from_id, obligation_id AS to_id FROM corpus_obligations WHERE ord % 2 = 0")
def subgraph(spark, sf_dir):
    m = model(spark, sf_dir)
    keep = m.parties.select("document_id", "id").unionByName(m.obligations.where("ord % 2 = 0").select("document_id", "id"))
    return R.subgraph(_owes(m), keep).select("document_id", "from_id", "to_id")


@query("node_search", "R13", DUTIES + f", {_VIEW}, asked AS (SELECT * FROM (VALUES ('party'), (' Signal '), ('renew'), ('')) v(needle)) SELECT needle, document_id, count(*) AS n, min(id) AS first FROM vnodes JOIN asked ON contains(lower(label), lower(trim(needle))) OR contains(entity_type, lower(trim(needle))) OR contains(lower(type_label), lower(trim(needle))) GROUP BY ALL")
def node_search(spark, sf_dir):
    nodes, _ = _view(spark, sf_dir)
    found = [R.search(nodes, text).withColumn("needle", F.lit(text)) for text in ("party", " Signal ", "renew", "")]
    return reduce(lambda x, y: x.unionByName(y), found).groupBy("needle", "document_id").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(
    "node_rows", "R15",
    DUTIES + f""", {_VIEW}, near AS (SELECT v.document_id, v.id, concat(words, tail) AS phrase, category, type, other_id, label AS other_label, type_label AS other_type FROM vends v JOIN reads USING (type) JOIN vnodes n ON n.document_id = v.document_id AND n.id = v.other_id),
      told AS (SELECT document_id, id, string_agg(concat(category, ':', phrase, ' ', other_type, ' ', other_id), ',' ORDER BY phrase, category, type, other_id) AS links, string_agg(concat(phrase, ' ', other_label), ' ' ORDER BY phrase, category, type, other_id) AS said FROM near GROUP BY ALL)
      SELECT n.document_id, n.id, type_label, coalesce(links, '') AS links FROM vnodes n LEFT JOIN told t ON t.document_id = n.document_id AND t.id = n.id WHERE contains(lower(concat_ws(' ', label, type_label, said)), 'written')""",
)
def node_rows(spark, sf_dir):
    """The rows that hold a word, in label, type, phrases or neighbours."""
    links = F.array_join(F.transform("links", lambda x: F.concat(x["category"], F.lit(":"), x["phrase"], F.lit(" "), x["other_type_label"], F.lit(" "), x["other_id"])), ",")
    return R.rows(*_view(spark, sf_dir, dealt=True), text=" WRITTEN", dealt=True).select("document_id", "id", "type_label", links.alias("links"))


@query("graph_findings", "R16", DUTIES + f", {SIGNALS} SELECT document_id, finding_id AS from_id, clause_id AS to_id FROM signals WHERE clause_id IS NOT NULL")
def graph_findings(spark, sf_dir):
    m = model(spark, sf_dir, dealt=True)
    nodes = m.clauses.select("document_id", F.col("clause_id").alias("id"), F.lit("clause").alias("entity_type"), F.col("heading").alias("label"))
    _, edges = R.with_findings(nodes, R.edge(m.obligations, "clause-imposes-obligation", "clause_id", "clause", "id", "obligation"), signals(spark, sf_dir, m), dealt=True)
    return edges.where("type = 'risk-about'").select("document_id", "from_id", "to_id")


@query("default_focus", "R17", DUTIES + f", {_VIEW}, {_FOCUS} SELECT document_id, focus FROM vfocus")
def default_focus(spark, sf_dir):
    return R.default_focus(*_view(spark, sf_dir))


@query("cycles", "R10", ctes("corpus_a") + "SELECT document_id, CAST(0 AS INT) AS cycle, concat(string_agg(clause_id, '>' ORDER BY clause_id), '>', min(clause_id)) AS path FROM corpus_a GROUP BY document_id HAVING count(*) > 1")
def cycles(spark, sf_dir):
    """Every contract's clauses in a ring, by id."""
    (a,) = corpus(spark, sf_dir, "corpus_a")
    ring = a.groupBy("document_id").agg(F.array_sort(F.collect_list("clause_id")).alias("ids")).where(F.size("ids") > 1)
    edges = ring.select("document_id", F.posexplode("ids").alias("at", "from_id"), "ids").select("document_id", "from_id", F.col("ids")[F.pmod(F.col("at") + 1, F.size("ids"))].alias("to_id"))
    return R.cycles(edges).select("document_id", "cycle", F.array_join("path", ">").alias("path"))


# --- versions, questions, views ----------------------------------------------------------------


@query("change_totals", "D18", ctes("corpus_a") + f", {_KINDS} SELECT document_id, change, count(*) AS n FROM kinds GROUP BY ALL")
def change_totals(spark, sf_dir):
    return M.totals(_kinds(spark, sf_dir))


@query("change_words", "D21", ctes("corpus_a") + f", {_KINDS} SELECT document_id, clause_id, concat('Clause “', clause_id, '” was ', change) AS said FROM kinds")
def change_words(spark, sf_dir):
    return _kinds(spark, sf_dir).select("document_id", F.col("id_a").alias("clause_id"), M.describe(F.col("change"), F.lit("clause"), F.col("id_a")).alias("said"))


@query("shared_terms", "D20", ctes("corpus_b") + f"SELECT a.document_id, a.clause_id, CAST(least(8, len(list_intersect(list_filter(string_split({sql_phrase('a.text')}, ' '), lambda w: length(w) > 3), list_filter(string_split({sql_phrase('b.text')}, ' '), lambda w: length(w) > 3)))) AS INT) AS shared FROM corpus_a a JOIN corpus_b b ON b.clause_id = a.clause_id")
def shared_terms(spark, sf_dir):
    a, b = corpus(spark, sf_dir, "corpus_a", "corpus_b")
    x = a.join(b.select("clause_id", F.col("text").alias("other")), "clause_id")
    return x.select("document_id", "clause_id", F.size(M.shared_terms(F.col("text"), F.col("other"))).alias("shared"))


@query(
    "impact_totals", "M5",
    DUTIES + """, c AS (SELECT document_id, clause_id FROM corpus_a WHERE l_suppkey % 7 = 0), r AS (SELECT c.document_id, c.clause_id AS source, o.obligation_id AS id, 1 AS distance FROM c JOIN corpus_obligations o ON o.clause_id = c.clause_id
      UNION ALL SELECT c.document_id, c.clause_id, o.deadline_id, 2 FROM c JOIN corpus_obligations o ON o.clause_id = c.clause_id WHERE o.deadline_id IS NOT NULL) SELECT document_id, CAST(distance AS INT) AS distance, count(DISTINCT id) AS reached, count(DISTINCT source) AS changes FROM r GROUP BY ALL""",
)
def impact_totals(spark, sf_dir):
    m = model(spark, sf_dir)
    changed = m.a.where("l_suppkey % 7 = 0").select("document_id", F.col("clause_id").alias("id"))
    links = M.links([(m.obligations, "clause_id", "id", "imposes"), (m.obligations, "id", "deadline_id", "due")])
    return M.impact_totals(M.impact(changed, links, levels=2))


@query("findings_by_category", "K14", DUTIES + f", {SIGNALS}, kinds AS (SELECT * FROM (VALUES " + ", ".join(f"('{r}', '{c}')" for r, (c, _) in K.RULES.items()) + ") v(rule_id, category)) SELECT document_id, category, string_agg(finding_id, ',' ORDER BY place) AS finding_ids FROM signals JOIN kinds USING (rule_id) GROUP BY ALL")
def findings_by_category(spark, sf_dir):
    return K.by_category(signals(spark, sf_dir)).select("document_id", "category", F.array_join("finding_ids", ",").alias("finding_ids"))


_CLEAN = r"lower(regexp_replace(trim(s), '[.\s]+$', ''))"


@query(
    "question_suggestions", "A9",
    DUTIES + f""", k AS (SELECT document_id, 0 AS kind, ord, concat(heading, ' risk. . ') AS s FROM corpus_a WHERE l_suppkey % 3 = 0 UNION ALL SELECT document_id, 1, ord, description FROM corpus_deadlines UNION ALL SELECT document_id, 2, ord, summary FROM corpus_obligations),
      t AS (SELECT *, row_number() OVER (PARTITION BY document_id, kind ORDER BY ord) AS r FROM k), q AS (SELECT document_id, kind, r, CASE kind WHEN 0 THEN concat('What does the document say about ', {_CLEAN}, '?') WHEN 1 THEN concat('When is the deadline for ', {_CLEAN}, '?') ELSE concat('Who is responsible for: ', {_CLEAN}, '?') END AS question FROM t WHERE r <= 2)
      SELECT document_id, place, question FROM (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY kind, r) AS INT) AS place FROM q) z WHERE place <= 5""",
)
def question_suggestions(spark, sf_dir):
    m = model(spark, sf_dir)
    risks = m.a.where("l_suppkey % 3 = 0").select("document_id", "ord", F.concat("heading", F.lit(" risk. . ")).alias("title"))
    return A.suggestions(risks, m.deadlines, m.obligations)


@query("obligation_rows", "U5", DUTIES + "SELECT o.document_id, o.obligation_id, p.name AS obligor, q.name AS obligee, a.number AS clause_number, d.description AS deadline FROM corpus_obligations o LEFT JOIN corpus_parties p ON p.document_id = o.document_id AND p.party_id = o.obligor_id LEFT JOIN corpus_parties q ON q.document_id = o.document_id AND q.party_id = o.obligee_id LEFT JOIN corpus_a a ON a.clause_id = o.clause_id LEFT JOIN corpus_deadlines d ON d.deadline_id = o.deadline_id")
def obligation_rows(spark, sf_dir):
    m = model(spark, sf_dir)
    return U.obligation_rows(m.obligations, m.parties, m.clauses, m.deadlines).select("document_id", F.col("id").alias("obligation_id"), "obligor", "obligee", "clause_number", "deadline")


@query("document_rows", "U8", DUTIES + "SELECT d.document_id, (SELECT count(*) FROM corpus_obligations o WHERE o.document_id = d.document_id) AS duties, (SELECT count(*) FROM corpus_rights r WHERE r.document_id = d.document_id) AS rights FROM (SELECT DISTINCT document_id FROM corpus_a) d")
def document_rows(spark, sf_dir):
    m = model(spark, sf_dir)
    return U.document_rows(m.a.select("document_id").distinct(), {"duties": m.obligations, "rights": m.rights})


@query("fact_rows", "U11", DUTIES + "SELECT document_id, right_id AS id, place, field, value FROM (SELECT document_id, right_id, CAST(0 AS INT) AS place, 'holder_party_id' AS field, holder_id AS value FROM corpus_rights UNION ALL SELECT document_id, right_id, 1, 'counterparty_party_id', counterparty_id FROM corpus_rights) z")
def fact_rows(spark, sf_dir):
    return U.fact_rows(model(spark, sf_dir).rights, ["holder_party_id", "counterparty_party_id"])


# --- citations of clauses, findings of entities, providers ---------------------------------------


@query(
    "clause_citations", "D7",
    ctes("corpus_obligations", "corpus_deadlines") + """, ev AS (
        SELECT document_id, CASE WHEN ord % 2 = 0 THEN clause_id ELSE concat(document_id, '-1') END AS cited, summary AS q, concat('e', clause_id) AS id, clause_id AS home FROM corpus_obligations
        UNION ALL SELECT document_id, NULL, description, concat('f', clause_id), clause_id FROM corpus_deadlines),
      hung AS (SELECT document_id, home AS clause_id, cited, q, id FROM ev UNION SELECT document_id, cited, cited, q, id FROM ev WHERE cited IS NOT NULL)
      SELECT document_id, clause_id, count(*) AS quotes, min(id) AS first_id FROM (SELECT document_id, clause_id, cited, q, min(id) AS id FROM hung GROUP BY ALL) z GROUP BY ALL""",
)
def clause_citations(spark, sf_dir):
    """Duties quote their own clause or the first one of the contract; deadlines quote without a clause."""
    m = model(spark, sf_dir)
    offset = F.lit(None).cast("int").alias("start_offset")
    place = F.when(F.col("ord") % 2 == 0, F.col("clause_id")).otherwise(F.concat(F.col("document_id").cast("string"), F.lit("-1")))
    duties = m.obligations.select("document_id", F.col("id").alias("entity_id"), place.alias("clause_id"), F.col("summary").alias("source_text"), offset, F.concat(F.lit("e"), "clause_id").alias("id"))
    dates = m.deadlines.select("document_id", F.col("id").alias("entity_id"), F.lit(None).cast("string").alias("clause_id"), F.col("description").alias("source_text"), offset, F.concat(F.lit("f"), "clause_id").alias("id"))
    facts = V.collect_facts({"obligation": m.obligations, "deadline": m.deadlines})
    found = M.clause_citations(m.clauses, facts, duties.unionByName(dates))
    return found.groupBy("document_id", F.col("of_clause").alias("clause_id")).agg(F.count("*").alias("quotes"), F.min("id").alias("first_id"))


@query("findings_of_entity", "I10", ctes("corpus_rights") + f", {_SAID}, f AS ({I1_SQL}) SELECT r.document_id, r.right_id AS id, count(*) AS findings FROM f JOIN corpus_rights r ON r.document_id = f.document_id AND (r.clause_id = f.clause_id OR r.clause_id = f.entity_id) GROUP BY ALL")
def findings_of_entity(spark, sf_dir):
    m = model(spark, sf_dir)
    wanted = m.rights.select("document_id", "id", F.array("clause_id").alias("clause_ids"))
    return I.of_entities(I.conflicting_notice(m.clauses), wanted).groupBy("document_id", "id").agg(F.count("*").alias("findings"))


@query("document_entities", "X17", "SELECT page_id AS document_id, CASE WHEN page_id % 2 = 0 THEN concat('Contract ', page_id) WHEN page_id % 3 = 0 THEN 'Untitled document' ELSE url END AS title, CASE WHEN page_id % 2 = 0 THEN 'lease' ELSE 'unknown' END AS document_type, CAST(coalesce(length(html), 0) AS INT) AS char_count FROM pages")
def document_entities(spark, sf_dir):
    """Every second page has hints, every third no file name."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    content = pages.select(F.col("page_id").alias("document_id"), F.when(F.col("page_id") % 3 != 0, F.col("url")).alias("file_name"), F.lit("html").alias("file_type"), F.lit(None).cast("int").alias("page_count"), F.col("html").alias("text"), F.lit(None).cast("array<string>").alias("warnings"))
    hints = pages.where("page_id % 2 = 0").select(F.col("page_id").alias("document_id"), F.concat(F.lit("Contract "), F.col("page_id").cast("string")).alias("title"), F.lit("lease").alias("document_type"), F.lit(None).cast("date").alias("effective_date"))
    return X.document_entities(content, hints).select("document_id", "title", "document_type", F.col("metadata.char_count").alias("char_count"))


@query("reply_checks", "X18", rf"WITH r AS (SELECT doc_id AS document_id, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE text END AS reply FROM documents) SELECT document_id, CASE WHEN reply IS NULL THEN '{X.NO_TEXT}' WHEN NOT regexp_matches(reply, '[^ \t\n\x0B\f\r]') THEN '{X.EMPTY_REPLY}' WHEN length(reply) > 2000000 THEN '{X.LONG_REPLY}' END AS error, reply IS NULL OR NOT regexp_matches(reply, '[^ \t\n\x0B\f\r]') AS no_user FROM r")
def reply_checks(spark, sf_dir):
    """Texts as replies, of which every fourth is missing and every fourth blank, and as prompts."""
    n = F.col("doc_id") % 4
    said = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.when(n == 0, None).when(n == 1, "  ").otherwise(F.col("text")).alias("reply"))
    asked = X.prompt_problems(F.lit("Extract."), F.col("reply"))
    return X.checked(said.withColumn("no_user", F.array_contains(asked, X.NO_USER)).withColumn("error", F.lit(None).cast("string"))).select("document_id", "error", "no_user")
