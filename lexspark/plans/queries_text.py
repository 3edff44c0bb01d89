"""Queries over texts, clauses and ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import clauses as C
from ..operators import views as U
from ..sources import ingest as S
from .corpus import corpus, ctes
from .model import documents, model
from .registry import query

_SPACE = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def sql_phrase(x: str) -> str:
    return rf"trim(regexp_replace(lower(coalesce({x}, '')), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def sql_matches(x: str, patterns: list[str]) -> str:
    return f"regexp_matches({x}, '(?i){'|'.join(f'(?:{p})' for p in patterns)}')"


def sql_clause_type(head: str, whole: str) -> str:
    defines = C.DEFINES.replace("'", "''")
    rules = [f"WHEN {sql_matches(head, p)} THEN '{t}'" for t, p in C.HEADING_TYPES]
    rules += [f"WHEN regexp_matches({whole}, '{defines}') THEN 'definitions'"] + [f"WHEN {sql_matches(whole, p)} THEN '{t}'" for t, p in C.TEXT_TYPES]
    return "CASE " + " ".join(rules) + " ELSE 'other' END"


@query("clause_types", "C7", ctes("corpus_a") + f"SELECT document_id, clause_id, {sql_clause_type('heading', 'concat(heading, chr(10), text)')} AS clause_type FROM corpus_a")
def clause_types(spark, sf_dir):
    return model(spark, sf_dir).clauses.select("document_id", "clause_id", "clause_type")


@query("clause_types_by_text", "C7", ctes("corpus_a") + f"SELECT document_id, clause_id, {sql_clause_type('number', 'text')} AS clause_type FROM corpus_a")
def clause_types_by_text(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return C.classify(a.withColumn("heading", F.lit(None).cast("string"))).select("document_id", "clause_id", "clause_type")


@query("clause_headings", "C1", ctes("corpus_a") + "SELECT document_id, ord, number, heading, 2 AS level FROM corpus_a")
def clause_headings(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    h = C.heading(F.concat_ws(" ", "number", "heading"))
    return a.select("document_id", "ord", h.alias("h")).select("document_id", "ord", "h.number", "h.heading", "h.level")


def _content(a):
    line = F.concat(F.col("number"), F.lit(" "), F.col("heading"), F.lit("\n"), F.col("text"))
    return a.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("t")))), lambda s: s["t"]), "\n").alias("text"))


_SECTIONS = "sections AS (SELECT document_id, ord, number, heading, concat(number, ' ', heading, chr(10), text) AS t FROM corpus_a)"


@query(
    "clause_segments", "C2 C4",
    ctes("corpus_a") + ", " + _SECTIONS + """ SELECT document_id, ord, number, heading, 2 AS level,
      CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_offset, t AS text FROM sections""",
)
def clause_segments(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return C.segment(_content(a)).select("document_id", "ord", "number", "heading", "level", F.col("start_offset").cast("long").alias("start_offset"), "text")


_LEVEL = "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN 2 ELSE 3 END"


@query(
    "clause_parents", "C6",
    ctes("corpus_a") + f"""SELECT document_id, clause_id, CASE WHEN lag(lv) OVER w < lv THEN lag(clause_id) OVER w END AS parent_clause_id
      FROM (SELECT *, {_LEVEL} AS lv FROM corpus_a) x WINDOW w AS (PARTITION BY document_id ORDER BY ord)""",
)
def clause_parents(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return C.parents(a.withColumn("level", F.expr(_LEVEL))).select("document_id", "clause_id", "parent_clause_id")


@query(
    "clause_tree", "C9",
    ctes("corpus_a").replace("WITH ", "WITH RECURSIVE ", 1) + f""", p AS (SELECT document_id, clause_id, ord, CASE WHEN lag(lv) OVER w < lv THEN lag(clause_id) OVER w END AS up FROM (SELECT *, {_LEVEL} AS lv FROM corpus_a) x
      WINDOW w AS (PARTITION BY document_id ORDER BY ord)),
      t AS (SELECT document_id, clause_id, 0 AS depth FROM p WHERE up IS NULL UNION ALL SELECT p.document_id, p.clause_id, t.depth + 1 FROM p JOIN t ON p.up = t.clause_id)
      SELECT document_id, clause_id, depth FROM t""",
)
def clause_tree(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    tree = C.tree(C.parents(a.withColumn("level", F.expr(_LEVEL))), most_levels=3)
    return tree.select("document_id", "clause_id", "depth")


@query("section_paths", "C3", ctes("corpus_a") + f"""
      SELECT c.document_id, c.clause_id, (SELECT count(*) FROM (SELECT *, {_LEVEL} AS lv FROM corpus_a) o WHERE o.document_id = c.document_id AND o.ord < c.ord AND o.lv < c.lv
        AND NOT EXISTS (SELECT 1 FROM (SELECT *, {_LEVEL} AS lv FROM corpus_a) z WHERE z.document_id = c.document_id AND z.ord > o.ord AND z.ord <= c.ord AND z.lv <= o.lv)) + 1 AS depth
      FROM (SELECT *, {_LEVEL} AS lv FROM corpus_a) c""")
def section_paths(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return C.section_paths(a.withColumn("level", F.expr(_LEVEL))).select("document_id", "clause_id", F.size("section_path").cast("long").alias("depth"))


@query(
    "cross_references", "C5",
    ctes("corpus_a") + r"""SELECT a.document_id, a.clause_id, b.clause_id AS to_clause_id
      FROM (SELECT document_id, clause_id, unnest(regexp_extract_all(text, '(?i)(?:clause|section|§)\s*(\d+(?:\.\d+)*)', 1)) AS number FROM corpus_a) a
      JOIN corpus_a b ON a.document_id = b.document_id AND a.number = b.number WHERE a.clause_id <> b.clause_id""",
)
def cross_references(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return C.cross_references(a).select("document_id", "clause_id", "to_clause_id")


_OFFSETS = "placed AS (SELECT *, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY document_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS start_offset FROM corpus_a)"


@query("offset_to_clause", "C15", ctes("corpus_a") + f", {_OFFSETS} SELECT document_id, start_offset + CAST(n_days AS INT) AS \"offset\", clause_id FROM placed")
def offset_to_clause(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    placed = C.with_offsets(a)
    points = placed.select("document_id", (F.col("start_offset") + F.col("n_days").cast("int")).alias("offset"))
    return C.innermost_clause(points, placed).select("document_id", "offset", "clause_id")


@query(
    "clause_range_overlap", "C16",
    ctes("corpus_a") + f""", {_OFFSETS} SELECT p.document_id, p.clause_id AS range_id, q.clause_id FROM placed p JOIN placed q ON p.document_id = q.document_id
      AND q.start_offset <= p.start_offset + length(p.text) + 10 AND q.start_offset + length(q.text) >= p.start_offset""",
)
def clause_range_overlap(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    placed = C.with_offsets(a)
    ranges = placed.select("document_id", F.col("clause_id").alias("range_id"), F.col("start_offset").alias("from_offset"), (F.col("end_offset") + 10).alias("to_offset"))
    return C.clauses_in_range(ranges, placed)


# Intervals that nest, cross, touch and are empty, from the clauses, and points all over them.
_NESTED = """spans AS (SELECT document_id, ord, clause_id, CAST(ord * 7 + l_partkey % 5 AS INT) AS start_offset, CAST(ord * 7 + l_partkey % 5 + l_suppkey % 40 AS INT) AS end_offset FROM corpus_a),
    points AS (SELECT DISTINCT document_id, CAST(ord * 7 + q AS INT) AS "offset" FROM corpus_a, (VALUES (0), (3), (4), (20)) v(q))"""


def _nested(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    start = F.col("ord") * 7 + F.col("l_partkey") % 5
    spans = a.select("document_id", "ord", "clause_id", start.cast("int").alias("start_offset"), (start + F.col("l_suppkey") % 40).cast("int").alias("end_offset"))
    points = a.select("document_id", F.explode(F.transform(F.array(*[F.lit(q) for q in (0, 3, 4, 20)]), lambda q: F.col("ord") * 7 + q)).alias("offset")).distinct()
    return spans, points


@query(
    "nested_clauses", "C15",
    ctes("corpus_a") + f""", {_NESTED} SELECT p.document_id, p."offset", min_by(clause_id, (end_offset - start_offset) * 1000 + ord) AS clause_id
      FROM points p LEFT JOIN spans s ON s.document_id = p.document_id AND p."offset" >= start_offset AND p."offset" < end_offset GROUP BY ALL""",
)
def nested_clauses(spark, sf_dir):
    spans, points = _nested(spark, sf_dir)
    return C.innermost_clause(points, spans).select("document_id", "offset", "clause_id")


@query(
    "highlight_segments", "U9",
    ctes("corpus_a") + f""", {_NESTED}, marks AS (SELECT document_id, start_offset AS h0, end_offset AS h1 FROM spans WHERE end_offset > start_offset AND ord % 2 = 0), blocks AS (SELECT document_id, ord, CAST(ord * 20 - 20 AS BIGINT) AS b0, CAST(ord * 20 - 1 AS BIGINT) AS b1 FROM corpus_a),
      cuts AS (SELECT document_id, ord, b0 AS c FROM blocks UNION SELECT document_id, ord, b1 FROM blocks UNION SELECT b.document_id, ord, greatest(h, b0) FROM blocks b JOIN (SELECT document_id, h0 AS h, h0, h1 FROM marks UNION ALL SELECT document_id, h1, h0, h1 FROM marks) m ON m.document_id = b.document_id AND h > b0 AND h < b1),
      parts AS (SELECT document_id, ord, c, lead(c) OVER (PARTITION BY document_id, ord ORDER BY c) AS d FROM cuts), each AS (SELECT *, EXISTS (SELECT 1 FROM marks m WHERE m.document_id = p.document_id AND h0 <= c AND h1 >= d) AS marked FROM parts p WHERE d IS NOT NULL),
      runs AS (SELECT *, CASE WHEN marked = lag(marked) OVER (PARTITION BY document_id, ord ORDER BY c) THEN 0 ELSE 1 END AS fresh FROM each), named AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id, ord ORDER BY c) AS run FROM runs)
      SELECT document_id, ord AS block, min(c) AS "from", max(d) AS "to", marked FROM named GROUP BY document_id, ord, run, marked""",
)
def highlight_segments(spark, sf_dir):
    """Blocks cut by their merged highlights."""
    spans, _ = _nested(spark, sf_dir)
    merged = U.merge_intervals(spans.where("end_offset > start_offset and ord % 2 = 0"), ["document_id"])
    (a,) = corpus(spark, sf_dir, "corpus_a")
    blocks = a.select("document_id", F.col("ord").alias("block"), (F.col("ord") * 20 - 20).alias("start_offset"), (F.col("ord") * 20 - 1).alias("end_offset"))
    return U.segments(blocks, merged)


_LINES = "lines0 AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)"


@query(
    "paragraphs", "C13",
    f"""WITH {_LINES}, l AS (SELECT *, regexp_matches(line, '\\S') AS f, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM lines0),
      m AS (SELECT *, CASE WHEN f AND NOT coalesce(lag(f) OVER (PARTITION BY document_id ORDER BY pos), false) THEN 1 ELSE 0 END AS fresh FROM l),
      g AS (SELECT *, sum(fresh) OVER (PARTITION BY document_id ORDER BY pos) - 1 AS p FROM m)
      SELECT document_id, CAST(p AS BIGINT) AS paragraph, CAST(min(s) AS BIGINT) AS start_offset, CAST(max(s + length(line)) AS BIGINT) AS end_offset FROM g WHERE f GROUP BY document_id, p""",
)
def paragraphs(spark, sf_dir):
    out = C.paragraphs(documents(spark, sf_dir))
    return out.select("document_id", F.col("paragraph").cast("long").alias("paragraph"), F.col("start_offset").cast("long").alias("start_offset"), F.col("end_offset").cast("long").alias("end_offset"))


@query(
    "page_index", "S4 S5",
    f"""WITH {_LINES}, p AS (SELECT document_id, pos, regexp_replace(line, '^\\s+|\\s+$', '', 'g') AS t FROM lines0)
      SELECT document_id, CAST(pos + 1 AS INT) AS page_number, CAST(coalesce(sum(length(t) + 2) OVER (PARTITION BY document_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS char_start, length(t) AS n_chars FROM p""",
)
def page_index(spark, sf_dir):
    pages = S.pages(documents(spark, sf_dir).withColumnRenamed("text", "raw"), separator="\n")
    return pages.select("document_id", "page_number", "char_start", (F.col("char_end") - F.col("char_start")).cast("long").alias("n_chars"))


@query(
    "text_search", "S12",
    """WITH s AS (SELECT doc_id AS document_id, string_split(lower(text), 'ing ') AS parts FROM documents WHERE text IS NOT NULL),
      g AS (SELECT document_id, unnest(list_transform(parts[1:len(parts) - 1], lambda x: length(x))) AS n, generate_subscripts(parts[1:len(parts) - 1], 1) - 1 AS pos FROM s),
      o AS (SELECT document_id, pos, sum(n + 4) OVER (PARTITION BY document_id ORDER BY pos) - 4 AS o FROM g)
      SELECT document_id, CAST(pos AS INT) AS place, CAST(o AS INT) AS "offset" FROM o WHERE pos < 50""",
)
def text_search(spark, sf_dir):
    return S.find_text(documents(spark, sf_dir), "ing ").select("document_id", "place", "offset")


@query(
    "upload_gate", "S1 S2",
    """WITH f AS (SELECT page_id, concat('page', CAST(page_id AS VARCHAR), CASE page_id % 4 WHEN 0 THEN '.pdf' WHEN 1 THEN '.TXT' WHEN 2 THEN '.exe' ELSE '.md' END) AS name, CASE WHEN page_id % 7 = 0 THEN 0 ELSE octet_length(encode(html)) * 2000 END AS n_bytes FROM pages)
      SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'pdf' WHEN 1 THEN 'txt' WHEN 3 THEN 'md' END AS file_type,
        CASE WHEN page_id % 4 = 2 THEN 'upload.unsupported-type' WHEN n_bytes <= 0 THEN 'upload.empty' WHEN n_bytes > 26214400 THEN 'upload.too-large' END AS code FROM f""",
)
def upload_gate(spark, sf_dir):
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    ending = F.when(F.col("page_id") % 4 == 0, ".pdf").when(F.col("page_id") % 4 == 1, ".TXT").when(F.col("page_id") % 4 == 2, ".exe").otherwise(".md")
    f = p.select("page_id", F.concat(F.lit("page"), F.col("page_id").cast("string"), ending).alias("name"), F.when(F.col("page_id") % 7 == 0, 0).otherwise(F.octet_length("html").cast("long") * 2000).alias("n_bytes"))
    mime = F.lit(None).cast("string")
    return f.select("page_id", S.file_type(F.col("name"), mime).alias("file_type"), S.upload_code(F.col("name"), mime, F.col("n_bytes")).alias("code"))


_CONTROL = r"[\x{0000}-\x{0008}\x{000B}\x{000E}-\x{001F}\x{007F}-\x{009F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]"


def sql_sanitize(x: str) -> str:
    x = f"regexp_replace({x}, '{_CONTROL}', '', 'g')"
    x = rf"regexp_replace(regexp_replace({x}, '\r\n?', chr(10), 'g'), '[ \t]+\n', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n\n\n+', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query("sanitize_text", "N1 N3 N5", f"SELECT page_id, {sql_sanitize('html')} AS clean FROM pages")
def sanitize_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", T.sanitize(F.col("html")).alias("clean"))


def _re2(p: str) -> str:
    return p.replace("'", "''")


@query(
    "injection_scan", "N8",
    "SELECT doc_id AS document_id, CAST(least(10, " + " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{_re2(p)}'))" for _, p in T.INJECTIONS) + ") AS INT) AS found FROM documents",
)
def injection_scan(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.size(T.injections(F.col("text"))).alias("found"))


def _sql_neutral(x: str) -> str:
    for _, p in T.INJECTIONS:
        x = f"regexp_replace({x}, '{_re2(p)}', '[document text: \\0]', 'g')"
    return x


@query("neutralize", "N9", f"SELECT doc_id AS document_id, sha256({_sql_neutral('text')}) AS sha FROM documents WHERE text IS NOT NULL")
def neutralize(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.sha2(T.neutralize(F.col("text")), 256).alias("sha"))


@query("redact", "N12", "SELECT c_custkey, concat(substr(c_name, 1, 4), repeat('*', least(24, length(c_name) - 8)), right(c_name, 4)) AS redacted FROM customer WHERE length(c_name) > 8 UNION ALL SELECT c_custkey, repeat('*', length(c_name)) FROM customer WHERE length(c_name) <= 8")
def redact(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", T.redact_secret(F.col("c_name")).alias("redacted"))


@query("norm_phrase", "N6 N7 T1", f"SELECT c_custkey, {sql_phrase('c_name')} AS key, CASE WHEN length(c_name) > 10 THEN concat(rtrim(substr(c_name, 1, 9)), '…') ELSE c_name END AS short FROM customer")
def norm_phrase(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", T.phrase(F.col("c_name")).alias("key"), T.cut(F.col("c_name"), 10).alias("short"))


@query("periods", "T2 T3 T4", ctes("corpus_a") + "SELECT clause_id, concat(CAST(n_days AS VARCHAR), ' days') AS phrase, CAST(n_days AS INT) AS amount, 'day' AS unit, CAST(n_days AS INT) AS n_days FROM corpus_a")
def periods(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return a.select("clause_id", F.explode(T.periods(F.col("text"))).alias("p")).select("clause_id", "p.phrase", "p.amount", "p.unit", "p.n_days")


@query("quoted_terms", "T5", f"""SELECT document_id, count(DISTINCT k) AS terms FROM (SELECT doc_id AS document_id, {sql_phrase('t')} AS k, t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '"([^"\\n]{{3,60}})"', 1)) AS t FROM documents) q) x WHERE trim(t) <> '' GROUP BY document_id""")
def quoted_terms(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.size(T.quoted_terms(F.col("text"))).cast("long").alias("terms")).where("terms > 0")


_STARTERS = ", ".join(f"'{w}'" for w in T.SENTENCE_STARTERS)


@query("capitalized_terms", "T6", f"""SELECT document_id, count(DISTINCT k) AS terms FROM (SELECT doc_id AS document_id, {sql_phrase('t')} AS k, t FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{T.CAPITALIZED}')) AS t FROM documents) q
      WHERE lower(regexp_extract(t, '^[A-Za-z]+')) NOT IN ({_STARTERS})) x GROUP BY document_id""")
def capitalized_terms(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.size(T.capitalized_terms(F.col("text"))).cast("long").alias("terms")).where("terms > 0")


@query("secret_scan", "N13", "SELECT doc_id AS document_id, CAST(" + " + ".join(f"len(regexp_extract_all(coalesce(text, ''), '{_re2(p)}'))" for p in T.SECRETS.values()) + " AS INT) AS secrets FROM documents")
def secret_scan(spark, sf_dir):
    return documents(spark, sf_dir).select("document_id", F.size(T.secrets(F.col("text"))).alias("secrets"))
