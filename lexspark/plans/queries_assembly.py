"""Queries over the assembly of models from proposals; the replies are written from the derived corpus."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import assembly as X
from ..operators import drafts as X4
from ..operators import provider_runs as P
from ..shared import shared_dir, written
from .corpus import corpus, ctes
from .registry import query


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clauses with the names of their parties."""
    a, = corpus(spark, sf_dir, "corpus_a")
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    people = read("orders").join(read("customer"), F.col("c_custkey") == F.col("o_custkey")).select(F.col("o_orderkey").alias("document_id"), "c_name")
    return a.join(people, "document_id").join(read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"), "l_suppkey")


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One reply for each of two overlapping chunks of a contract: clauses 1 to 4, and from 3 on.

    The second one writes names otherwise, names one party by its alias, and repeats clauses 3 and
    4. Duties of line 5 name a party that nobody declared; every eleventh part cites a clause that
    is not there; a third of the duties cite a deadline that nobody stated.
    """
    x = lines(spark, sf_dir).withColumn("chunk", F.explode(F.array_compact(F.array(F.when(F.col("ord") <= 4, 0), F.when(F.col("ord") >= 3, 1)))))
    ordinal = F.col("ord").cast("string")
    second = lambda name: F.when(F.col("chunk") == 1, F.concat(F.upper(name), F.lit("."))).otherwise(F.col(name))
    item = lambda when, **fields: F.when(when, F.struct(*[(F.lit(v) if isinstance(v, str) else v).alias(k) for k, v in fields.items()]))
    number = F.when(F.col("l_partkey") % 11 == 0, "99.9").otherwise(F.col("number"))
    made = {
        "suppliers": item(F.lit(True), name=second("s_name"), role="supplier", aliases=F.array(F.concat(F.lit("Supplier "), F.col("l_suppkey").cast("string")))),
        "definitions": item(F.col("l_returnflag") == "N", term=F.concat_ws(" ", "heading", ordinal), text=F.col("text"), clauseNumber=F.col("number")),
        "conditions": item(F.col("l_linenumber").isin(4, 6), ref=F.concat(F.lit("k"), ordinal), summary=F.col("heading"), clauseNumber=F.col("number")),
        "deadlines": item(F.col("l_linenumber") % 3 != 0, ref=F.concat(F.lit("d"), ordinal), description=F.col("text"), anchorClauseNumber=F.col("number"), offsetAmount=F.col("n_days"), offsetUnit="day", responsible="the CUSTOMER"),
        "consequences": item(F.col("l_partkey") % 2 == 0, ref=F.concat(F.lit("c"), ordinal), description=F.concat(F.lit("Fee for "), "number"), clauseNumber=F.col("number"), affectedParty=F.upper("s_name")),
        "obligations": item(
            F.col("l_returnflag") == "A", summary=F.col("text"), actor=F.when(F.col("l_linenumber") == 5, "Unknown Holdings").otherwise("The customer"), obligeeParty=F.concat(F.lit("SUPPLIER "), F.col("l_suppkey").cast("string")), clauseNumber=number,
            triggerConditionRef=F.when(F.col("l_linenumber").isin(4, 5, 6), F.concat(F.lit("k"), ordinal)), deadlineRef=F.concat(F.lit("d"), ordinal), consequenceRefs=F.array(F.concat(F.lit("c"), ordinal), F.lit("none")),
            evidence=F.array(F.struct(F.col("text").alias("sourceText"), F.when(F.col("l_linenumber") == 2, F.col("clause_id")).alias("clauseId"), F.col("number").alias("clauseNumber"))),
        ),
        "rights": item(F.col("l_returnflag") == "R", summary=F.col("text"), holder=F.col("s_name"), against=F.col("c_name"), clauseNumber=F.col("number")),
        "risks": item(F.col("l_suppkey") % 5 == 0, title=F.concat(F.lit("Risk of "), "heading"), clauseNumber=F.col("number"), severity="high"),
        "differ": item(F.col("l_returnflag") == "A", number=F.col("number")),
    }
    # One list a reply and not one a collection, of a column: what stands inside collect_list is interpreted.
    told = x.select("document_id", "chunk", "c_name", F.struct("ord", *[m.alias(k) for k, m in made.items()]).alias("told"))
    together = told.groupBy("document_id", "chunk", "c_name").agg(F.sort_array(F.collect_list("told")).alias("all"))
    of = lambda k: F.filter(F.transform("all", lambda v: v[k]), lambda m: m.isNotNull())
    first = F.struct(second("c_name").alias("name"), F.lit("customer").alias("role"), F.array(F.lit("the Customer")).alias("aliases"))
    last = F.when(F.col("chunk") == 1, F.array(F.struct(F.lit("THE CUSTOMER").alias("name"), F.lit("customer").alias("role"), F.array().cast("array<string>").alias("aliases")))).otherwise(F.array())
    numbers = F.struct(F.lit("Numbers differ").alias("title"), F.transform(of("differ"), lambda m: m["number"]).alias("clauseNumbers"))
    body = F.struct(F.concat(F.array(first), of("suppliers"), last).alias("parties"), *[of(k).alias(k) for k in made if k not in ("suppliers", "differ")], F.array(numbers).alias("inconsistencies"))
    return together.select("document_id", "chunk", F.to_json(body).alias("json"))


def assembled(spark: SparkSession, sf_dir: str) -> X.Model:
    return X.assemble(replies(spark, sf_dir), lines(spark, sf_dir).select("document_id", "clause_id", "number", "ord"))


def sql_id(prefix: str, entity: str, hint: str) -> str:
    """SQL of an entity's id."""
    code = f"list_reduce(list_prepend(CAST(5381 AS BIGINT), list_transform(string_split(concat('{entity}:', {hint}), ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, c: xor((a * 33) % 4294967296, c))"
    return f"concat('{prefix}_', left(regexp_replace(regexp_replace(lower({hint}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 32), '_', lower(to_base({code}, 36)))"


#: The items of each collection once, in the order of proposal, with their ids before collisions.
_ITEMS = f"""{ctes("corpus_a")}, named AS (SELECT a.*, c_name, s_name FROM corpus_a a JOIN orders ON o_orderkey = document_id JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey),
party AS (SELECT document_id, c_name AS name, {sql_id("party", "party", "concat(document_id, ':', c_name)")} AS id FROM (SELECT DISTINCT document_id, c_name, max(ord) OVER (PARTITION BY document_id) m FROM named)
  UNION ALL SELECT document_id, s_name, {sql_id("party", "party", "concat(document_id, ':', CASE WHEN o <= 4 THEN s_name ELSE concat(upper(s_name), '.') END)")} FROM (SELECT document_id, s_name, min(ord) o FROM named GROUP BY ALL)),
deadline AS (SELECT document_id, ord, {sql_id("dl", "deadline", "concat(document_id, ':d', ord)")} AS id, clause_id FROM named WHERE l_linenumber % 3 <> 0),
condition AS (SELECT document_id, ord, {sql_id("cond", "condition", "concat(document_id, ':k', ord)")} AS id, clause_id FROM named WHERE l_linenumber IN (4, 6)),
consequence AS (SELECT document_id, ord, {sql_id("cons", "consequence", "concat(document_id, ':c', ord)")} AS id, clause_id, s_name FROM named WHERE l_partkey % 2 = 0),
duty0 AS (SELECT *, {sql_id("obl", "obligation", "concat(document_id, ':', text)")} AS id0 FROM (SELECT *, row_number() OVER (PARTITION BY document_id, text, CASE WHEN l_partkey % 11 = 0 THEN '99.9' ELSE number END ORDER BY ord) AS turn FROM named WHERE l_returnflag = 'A') WHERE turn = 1),
duty AS (SELECT *, row_number() OVER (PARTITION BY document_id, id0 ORDER BY ord) AS nth, CASE WHEN row_number() OVER (PARTITION BY document_id, id0 ORDER BY ord) = 1 THEN id0 ELSE concat(id0, '_', row_number() OVER (PARTITION BY document_id, id0 ORDER BY ord)) END AS id, CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE clause_id END AS duty_clause FROM duty0)
"""


@query(
    "assembled_duties", "X13 X14 U14",
    _ITEMS + """SELECT d.document_id, d.id, text AS summary, duty_clause AS clause_id, CASE WHEN l_linenumber <> 5 THEN c.id END AS obligor_party_id, s.id AS obligee_party_id,
    k.id AS trigger_condition_id, t.id AS deadline_id, coalesce(q.id, '') AS consequence_ids
    FROM duty d LEFT JOIN party c ON c.document_id = d.document_id AND c.name = d.c_name LEFT JOIN party s ON s.document_id = d.document_id AND s.name = d.s_name
    LEFT JOIN deadline t ON t.document_id = d.document_id AND t.ord = d.ord LEFT JOIN condition k ON k.document_id = d.document_id AND k.ord = d.ord AND l_linenumber IN (4, 5, 6) LEFT JOIN consequence q ON q.document_id = d.document_id AND q.ord = d.ord""",
)
def assembled_duties(spark, sf_dir):
    return assembled(spark, sf_dir).table("obligations").select("document_id", "id", "summary", "clause_id", "obligor_party_id", "obligee_party_id", "trigger_condition_id", "deadline_id", F.array_join("consequence_ids", ",").alias("consequence_ids"))


@query(
    "assembled_tables", "X14 U14",
    _ITEMS + f""", defined AS (SELECT document_id, {sql_id("def", "definition", "concat(document_id, ':', heading, ' ', ord)")} AS id, clause_id FROM named WHERE l_returnflag = 'N'),
right0 AS (SELECT *, {sql_id("right", "right", "concat(document_id, ':', text)")} AS id0 FROM named WHERE l_returnflag = 'R'),
risk0 AS (SELECT *, {sql_id("risk", "risk", "concat(document_id, ':Risk of ', heading)")} AS id0 FROM named WHERE l_suppkey % 5 = 0),
differ AS (SELECT DISTINCT document_id, chunk, list(number ORDER BY ord) FILTER (l_returnflag = 'A') AS numbers, min_by(clause_id, ord) FILTER (l_returnflag = 'A') AS clause_id FROM (SELECT *, unnest(list_filter([CASE WHEN ord <= 4 THEN 0 END, CASE WHEN ord >= 3 THEN 1 END], lambda v: v IS NOT NULL)) AS chunk FROM named) GROUP BY document_id, chunk),
differs AS (SELECT document_id, clause_id, chunk, {sql_id("inc", "inconsistency", "concat(document_id, ':Numbers differ')")} AS id0 FROM (SELECT *, row_number() OVER (PARTITION BY document_id, coalesce(numbers, []) ORDER BY chunk) AS turn FROM differ) WHERE turn = 1),
nth AS (SELECT document_id, 'rights' AS collection, id0, ord AS o, clause_id, (SELECT id FROM party p WHERE p.document_id = r.document_id AND p.name = s_name) AS party_id FROM right0 r
  UNION ALL SELECT document_id, 'risks', id0, ord, clause_id, NULL FROM risk0 UNION ALL SELECT document_id, 'inconsistencies', id0, chunk, clause_id, NULL FROM differs)
SELECT document_id, collection, CASE WHEN n = 1 THEN id0 ELSE concat(id0, '_', n) END AS id, clause_id, party_id FROM (SELECT *, row_number() OVER (PARTITION BY document_id, id0 ORDER BY o) AS n FROM nth)
UNION ALL SELECT document_id, 'parties', id, NULL, NULL FROM party UNION ALL SELECT document_id, 'definitions', id, clause_id, NULL FROM defined UNION ALL SELECT document_id, 'conditions', id, clause_id, NULL FROM condition
UNION ALL SELECT t.document_id, 'deadlines', t.id, t.clause_id, p.id FROM deadline t JOIN (SELECT DISTINCT document_id, c_name FROM named) l ON l.document_id = t.document_id JOIN party p ON p.document_id = t.document_id AND p.name = l.c_name
UNION ALL SELECT q.document_id, 'consequences', q.id, q.clause_id, p.id FROM consequence q JOIN party p ON p.document_id = q.document_id AND p.name = q.s_name""",
)
def assembled_tables(spark, sf_dir):
    party = F.coalesce(*[F.col("links")[f] for f in ("holderParty", "responsibleParty", "affectedParty")])
    return assembled(spark, sf_dir).entities.where("collection <> 'obligations'").select("document_id", "collection", "id", "clause_id", party.alias("party_id"))


@query(
    "assembly_unresolved", "X13 X14",
    _ITEMS + """SELECT document_id, id0 AS entity_id, field, said FROM (
    SELECT document_id, id0, 'obligorParty' AS field, 'Unknown Holdings' AS said FROM duty WHERE l_linenumber = 5 UNION ALL SELECT document_id, id0, 'clauseNumber', '99.9' FROM duty WHERE duty_clause IS NULL
    UNION ALL SELECT document_id, id0, 'deadlineRef', concat('d', ord) FROM duty WHERE l_linenumber % 3 = 0 UNION ALL SELECT document_id, id0, 'triggerConditionRef', concat('k', ord) FROM duty WHERE l_linenumber = 5
    UNION ALL SELECT document_id, id0, 'consequenceRefs', concat('c', ord) FROM duty WHERE l_partkey % 2 = 1 UNION ALL SELECT document_id, id0, 'consequenceRefs', 'none' FROM duty) u""",
)
def assembly_unresolved(spark, sf_dir):
    return assembled(spark, sf_dir).unresolved.select("document_id", "entity_id", "field", "said")


@query(
    "assembly_issues", "X11 X14 X16",
    _ITEMS + """SELECT document_id, code, count(*) AS n FROM (
    SELECT document_id, 'assemble.unresolved-clause' AS code FROM duty WHERE duty_clause IS NULL UNION ALL SELECT document_id, 'assemble.unresolved-party' FROM duty WHERE l_linenumber = 5
    UNION ALL SELECT document_id, 'assemble.id-collision' FROM duty WHERE nth > 1
    UNION ALL SELECT document_id, 'assemble.duplicate-party' FROM named GROUP BY document_id HAVING max(ord) >= 3) i GROUP BY ALL""",
)
def assembly_issues(spark, sf_dir):
    """Unresolved references and collisions of duties, and parties that another one's alias stands for."""
    made = assembled(spark, sf_dir)
    codes = ["assemble.unresolved-clause", "assemble.unresolved-party", "assemble.duplicate-party"]
    collided = made.entities.where("collection = 'obligations'").where(F.col("id").rlike("_[0-9]+$") & (F.size(F.split("id", "_")) == 4))
    collided = collided.groupBy("document_id").agg(F.count("*").alias("n")).select("document_id", F.lit("assemble.id-collision").alias("code"), "n")
    return made.issues.where(F.col("code").isin(codes)).unionByName(collided)


@query("assembled_evidence", "X13", _ITEMS + "SELECT document_id, id AS entity_id, clause_id, text AS source_text FROM duty")
def assembled_evidence(spark, sf_dir):
    """Each quote at the clause that it names by id or number, else at its entity's."""
    return assembled(spark, sf_dir).evidence.select("document_id", "entity_id", "clause_id", "source_text")


# --- runs of a provider ------------------------------------------------------------------------

_CHUNK = 2_000


def fixture(prompt: str) -> str:
    """A reply by the document named in the prompt: every 7th fails, every 5th is not JSON unless it is asked again, every 3rd has typographic quotes and a comma too many."""
    ident = int(re.search(r"Document (\d+),", prompt)[1])
    if ident % 7 == 0:
        raise ConnectionError("no connection")
    body = f'{{"parties": [{{"name": "Party {ident}", "aliases": ["P{ident}"]}}]}}'
    if ident % 5 == 0 and not prompt.startswith(P.AGAIN):
        return "I cannot help with that"
    return body.replace('"', "”")[:-2] + ",]}" if ident % 3 == 0 else body


def chunk_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts over pieces of the documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("document_id"), F.coalesce("text", F.lit("")).alias("text"))
    pieces = docs.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.length("text") - 1, F.lit(0)) / _CHUNK).cast("int"))))
    named = pieces.select("document_id", "chunk", F.concat(F.lit("Document "), "document_id", F.lit(", chunk "), "chunk", F.lit("\n"), F.substring("text", F.col("chunk") * _CHUNK + 1, F.lit(_CHUNK))).alias("text"))
    return X4.prompt(named).select("document_id", "chunk", "prompt")


_CHUNKS = f"WITH c AS (SELECT doc_id AS document_id, unnest(range(CAST(floor(greatest(length(coalesce(text, '')) - 1, 0) / {_CHUNK}) AS BIGINT) + 1)) AS chunk FROM documents)"


def _log(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/lexspark-replies-{uuid.uuid4().hex}"


@query(
    "provider_replies", "X1 X2 X4 X5 X16",
    f"""{_CHUNKS} SELECT document_id, CAST(chunk AS INT) AS chunk, CASE WHEN document_id % 7 = 0 THEN 'unasked' WHEN document_id % 3 = 0 THEN 'repaired' ELSE 'ok' END AS parse_status,
    CASE WHEN document_id % 7 <> 0 AND document_id % 5 = 0 THEN 2 ELSE 1 END AS asked, CASE WHEN document_id % 7 <> 0 THEN concat('Party ', document_id) END AS party, CASE WHEN document_id % 7 = 0 THEN 'ConnectionError: no connection' END AS error FROM c""",
)
def provider_replies(spark, sf_dir):
    replies = P.run(chunk_prompts(spark, sf_dir), fixture, _log(spark))
    return replies.select("document_id", "chunk", "parse_status", "asked", F.get_json_object("json", "$.parties[0].name").alias("party"), "error")


@query(
    "provider_resumed", "X1 X16",
    f"""{_CHUNKS} SELECT document_id, count(*) AS chunks, CASE WHEN document_id % 7 = 0 THEN count(*) ELSE 0 END AS failed, CASE WHEN document_id % 7 <> 0 AND document_id % 5 = 0 THEN count(*) ELSE 0 END AS asked_twice,
    CASE WHEN document_id % 7 = 0 THEN 'failed' ELSE 'ok' END AS status, (SELECT count(*) + count(*) FILTER (document_id % 7 <> 0 AND document_id % 5 = 0) FROM c) AS calls FROM c GROUP BY document_id""",
)
def provider_resumed(spark, sf_dir):
    """A run that stops after two waves, then a whole one, then a third: the report, and how many replies the log has in all."""
    prompts, log = written(chunk_prompts(spark, sf_dir), "chunk-prompts"), _log(spark)
    P.run(prompts, fixture, log, stop_after=2)
    P.run(prompts, fixture, log)
    done = P.report(P.run(prompts, fixture, log))
    calls = spark.read.schema(P.LOG).parquet(*P.folders(log)).agg(F.count("*").alias("calls"))
    return done.join(F.broadcast(calls), F.lit(True))
