"""Queries over duties, deadlines and the rules for risks and inconsistencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import consistency as I
from ..operators import deadlines as D
from ..operators import risk as K
from ..operators import rulekit
from .corpus import AS_OF, corpus, ctes
from .model import as_of, documents, model
from .queries_text import sql_clause_type, sql_phrase
from .registry import query

RESOLVED = "resolved AS (SELECT *, CASE WHEN date IS NOT NULL THEN date WHEN offset_amount IS NOT NULL THEN CAST(anchor_date + offset_amount AS DATE) END AS resolved_date, CASE WHEN date IS NULL AND offset_amount IS NULL THEN 'no-date-stated' END AS reason FROM corpus_deadlines)"
ASSESSED = f"""assessed AS (SELECT o.document_id, o.obligation_id, o.ord, o.obligor_id, o.summary, CASE WHEN NOT o.informational THEN CAST(r.resolved_date - DATE '{AS_OF}' AS INT) END AS days_left,
  r.deadline_id IS NOT NULL AS deadline_found,
  CASE WHEN o.informational THEN 'informational' WHEN r.resolved_date IS NULL THEN CASE WHEN o.trigger_id IS NOT NULL THEN 'conditional' ELSE 'unknown' END
    WHEN r.resolved_date < DATE '{AS_OF}' THEN 'overdue' WHEN r.resolved_date - DATE '{AS_OF}' <= {D.SOON_DAYS} THEN 'due' ELSE 'upcoming' END AS status
  FROM corpus_obligations o LEFT JOIN resolved r ON r.document_id = o.document_id AND r.deadline_id = o.deadline_id)"""
DUTIES = ctes("corpus_obligations", "corpus_deadlines", "corpus_parties", "corpus_rights") + f", {RESOLVED}, {ASSESSED} "


def sql_cut(x: str, most: int) -> str:
    return f"CASE WHEN length({x}) > {most} THEN concat(rtrim(substr({x}, 1, {most - 1})), '…') ELSE {x} END"


def assessed(spark, sf_dir):
    m = model(spark, sf_dir)
    return D.assess(m.obligations, m.deadlines, as_of())


@query("deadline_resolve", "O1 O2", DUTIES + "SELECT document_id, deadline_id, resolved_date, reason FROM resolved")
def deadline_resolve(spark, sf_dir):
    return D.resolve(model(spark, sf_dir).deadlines, as_of()).select("document_id", F.col("id").alias("deadline_id"), "resolved_date", "reason")


@query("obligation_assess", "O3", DUTIES + "SELECT document_id, obligation_id, status, days_left FROM assessed")
def obligation_assess(spark, sf_dir):
    return assessed(spark, sf_dir).select("document_id", F.col("id").alias("obligation_id"), "status", "days_left")


_STATES = ", ".join(f"('{s}')" for s in D.STATUSES)


@query(
    "obligation_summary", "O6",
    DUTIES + f"""SELECT g.document_id, g.status, CAST(count(a.obligation_id) AS BIGINT) AS n FROM (SELECT DISTINCT document_id, v.status FROM assessed, (VALUES {_STATES}) v(status)) g
      LEFT JOIN assessed a ON a.document_id = g.document_id AND a.status = g.status GROUP BY g.document_id, g.status""",
)
def obligation_summary(spark, sf_dir):
    return D.count_by(assessed(spark, sf_dir), "status", D.STATUSES, "document_id")


@query(
    "timeline_buckets", "O5 O12",
    DUTIES + f"""SELECT r.document_id, r.deadline_id, o.obligation_id, CASE WHEN resolved_date IS NULL THEN 'undated' WHEN resolved_date < DATE '{AS_OF}' THEN 'past' WHEN resolved_date - DATE '{AS_OF}' <= {D.SOON_DAYS} THEN 'due-soon' ELSE 'future' END AS bucket,
      CAST(row_number() OVER (PARTITION BY r.document_id ORDER BY resolved_date NULLS LAST, r.deadline_id) AS INT) AS place
      FROM resolved r LEFT JOIN corpus_obligations o ON o.document_id = r.document_id AND o.deadline_id = r.deadline_id""",
)
def timeline_buckets(spark, sf_dir):
    m = model(spark, sf_dir)
    return D.timeline(m.deadlines, m.obligations, as_of()).select("document_id", F.col("id").alias("deadline_id"), "obligation_id", "bucket", "place")


@query(
    "timeline_kind", "O11",
    ctes("corpus_deadlines") + f""", t AS (SELECT d.document_id, d.deadline_id, d.description AS s, {sql_clause_type('a.heading', "concat(a.heading, chr(10), a.text)")} AS ct FROM corpus_deadlines d JOIN corpus_a a ON a.clause_id = d.clause_id)
      SELECT document_id, deadline_id, CASE WHEN ct = 'renewal' OR regexp_matches(s, '(?i)renew|extension|successive term|further term') THEN 'renewal'
        WHEN ct = 'termination' AND regexp_matches(s, '(?i)terminat|expiry|expire|end of (?:the )?term|cancel') THEN 'termination'
        WHEN ct = 'payment' OR regexp_matches(s, '(?i)invoice|payment|pay |fees?|remuneration|salary|interest|refund|deposit') THEN 'payment'
        WHEN ct = 'notice' OR regexp_matches(s, '(?i)notice|notify|notification') THEN 'notice' ELSE 'deadline' END AS kind FROM t""",
)
def timeline_kind(spark, sf_dir):
    m = model(spark, sf_dir)
    rows = m.deadlines.join(m.clauses.select("document_id", "clause_id", "clause_type"), ["document_id", "clause_id"])
    return rows.select("document_id", F.col("id").alias("deadline_id"), D.kind(F.col("clause_type"), F.col("description")).alias("kind"))


@query(
    "obligation_board", "O8 O13",
    DUTIES + """SELECT document_id, count(*) AS total, count(*) FILTER (status = 'overdue') AS overdue, count(*) FILTER (status = 'due') AS due, count(*) FILTER (status = 'upcoming') AS upcoming,
      count(*) FILTER (status = 'conditional') AS conditional, count(*) FILTER (status = 'unknown') AS undated, count(*) FILTER (status = 'informational') AS informational FROM assessed GROUP BY document_id""",
)
def obligation_board(spark, sf_dir):
    return D.board(assessed(spark, sf_dir))


@query("duties_by_party", "O7", DUTIES + "SELECT document_id, obligor_id AS party_id, status, count(*) AS duties FROM assessed GROUP BY ALL")
def duties_by_party(spark, sf_dir):
    return D.by_party(assessed(spark, sf_dir))


@query(
    "party_options", "O8",
    DUTIES + """, n AS (SELECT document_id, obligor_id AS party_id, count(*) AS duties FROM assessed GROUP BY ALL), m AS (SELECT n.*, coalesce(p.name, n.party_id) AS name FROM n LEFT JOIN corpus_parties p ON p.document_id = n.document_id AND p.party_id = n.party_id)
      SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY duties DESC, name, party_id) AS INT) AS place FROM m""",
)
def party_options(spark, sf_dir):
    return D.party_options(assessed(spark, sf_dir), model(spark, sf_dir).parties)


@query(
    "rights_board", "O9",
    DUTIES + """, r AS (SELECT r.document_id, r.right_id, o.obligation_id, o.ord FROM corpus_rights r JOIN corpus_obligations o ON o.document_id = r.document_id AND (o.clause_id = r.clause_id OR o.obligor_id = r.counterparty_id))
      SELECT document_id, right_id, obligation_id, place FROM (SELECT *, CAST(row_number() OVER (PARTITION BY document_id, right_id ORDER BY ord, obligation_id) AS INT) AS place FROM r) x WHERE place <= 6""",
)
def rights_board(spark, sf_dir):
    m = model(spark, sf_dir)
    return D.rights_board(m.rights, m.obligations)


@query("date_words", "O10 U12", DUTIES + """SELECT document_id, obligation_id, CASE WHEN days_left IS NULL THEN 'no date' WHEN days_left = 0 THEN 'today' WHEN days_left > 0 THEN concat('in ', days_left, CASE WHEN days_left = 1 THEN ' day' ELSE ' days' END)
      ELSE concat(-days_left, CASE WHEN days_left = -1 THEN ' day' ELSE ' days' END, ' ago') END AS due FROM assessed""")
def date_words(spark, sf_dir):
    return assessed(spark, sf_dir).select("document_id", F.col("id").alias("obligation_id"), D.due_in(F.col("days_left")).alias("due"))


# --- risk rules --------------------------------------------------------------------------------

_SHOWN = ["document_id", "rule_id", "severity", "clause_id", "entity_id", "title"]
#: Clauses with wordings that the derived corpus lacks.
_WORDY = "wordy AS (SELECT * REPLACE (CASE WHEN l_partkey % 10 = 0 THEN concat(text, ' The Supplier has unlimited liability and acts at its sole discretion with reasonable efforts.') ELSE text END AS text) FROM corpus_a)"


def _wordy(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    more = F.concat("text", F.lit(" The Supplier has unlimited liability and acts at its sole discretion with reasonable efforts."))
    return a.withColumn("text", F.when(F.col("l_partkey") % 10 == 0, more).otherwise(F.col("text")))


def _rule(name: str, clause: str, entity: str, title: str, rest: str, severity: str | None = None) -> str:
    return f"SELECT document_id, '{name}' AS rule_id, '{severity or K.RULES[name][1]}' AS severity, {clause} AS clause_id, {entity} AS entity_id, {title} AS title {rest}"


K_SQL = {
    "obligation-without-deadline": _rule("obligation-without-deadline", "clause_id", "obligation_id", f"concat('No timing: ', {sql_cut('summary', 80)})", "FROM corpus_obligations WHERE NOT informational AND deadline_id IS NULL AND trigger_id IS NULL"),
    "obligation-without-consequence": _rule("obligation-without-consequence", "clause_id", "obligation_id", f"concat('No consequence: ', {sql_cut('summary', 80)})", "FROM corpus_obligations WHERE NOT informational AND NOT has_consequence"),
    "deadline-unresolvable": _rule("deadline-unresolvable", "clause_id", "deadline_id", f"concat('No date: ', {sql_cut('description', 80)})", "FROM resolved WHERE reason IS NOT NULL"),
    "short-notice-period": _rule("short-notice-period", "clause_id", "deadline_id", "concat('Notice period of ', n_days, ' days')", "FROM (SELECT d.*, a.n_days, a.l_returnflag FROM corpus_deadlines d JOIN corpus_a a USING (document_id, clause_id)) z WHERE l_returnflag <> 'A' AND n_days BETWEEN 1 AND 29"),
    "automatic-renewal": _rule("automatic-renewal", "clause_id", "clause_id", "'automatic-renewal: automatically renew'", "FROM corpus_a WHERE l_returnflag NOT IN ('A', 'R')"),
    "obligation-imbalance": _rule("obligation-imbalance", "CAST(NULL AS VARCHAR)", "party", "concat(party, ' carries ', n, ' of ', n, ' duties')", "FROM (SELECT document_id, obligor_id AS party, count(*) AS n FROM corpus_obligations GROUP BY ALL HAVING count(*) >= 3) z"),
}


def _shown(df):
    return df.select(*_SHOWN)


@query("k_obligation_without_deadline", "K1", DUTIES + K_SQL["obligation-without-deadline"])
def k1(spark, sf_dir):
    return _shown(K.without_deadline(model(spark, sf_dir).obligations))


@query("k_obligation_without_consequence", "K2", DUTIES + K_SQL["obligation-without-consequence"])
def k2(spark, sf_dir):
    return _shown(K.without_consequence(model(spark, sf_dir).obligations))


@query("k_deadline_unresolvable", "K3", DUTIES + K_SQL["deadline-unresolvable"])
def k3(spark, sf_dir):
    return _shown(K.unresolvable(model(spark, sf_dir).deadlines, as_of()))


@query("k_short_notice", "K4", DUTIES + K_SQL["short-notice-period"])
def k4(spark, sf_dir):
    m = model(spark, sf_dir)
    return _shown(K.short_notice(m.deadlines, m.clauses))


@query("k_unlimited_liability", "K5", ctes("corpus_a") + f", {_WORDY} " + _rule("unlimited-liability", "clause_id", "clause_id", "'unlimited-liability: unlimited liability'", "FROM wordy WHERE l_partkey % 10 = 0"))
def k5(spark, sf_dir):
    return _shown(K.worded(_wordy(spark, sf_dir), "unlimited-liability"))


@query("k_automatic_renewal", "K6 K15", DUTIES + K_SQL["automatic-renewal"])
def k6(spark, sf_dir):
    return _shown(K.worded(model(spark, sf_dir).clauses, "automatic-renewal"))


@query("k_broad_discretion", "K7", ctes("corpus_a") + f", {_WORDY} " + _rule("broad-discretion", "clause_id", "clause_id", "'broad-discretion: sole discretion'", "FROM wordy WHERE l_partkey % 10 = 0"))
def k7(spark, sf_dir):
    return _shown(K.worded(_wordy(spark, sf_dir), "broad-discretion"))


@query(
    "k_vague_standard", "K8",
    ctes("corpus_obligations") + f", {_WORDY} " + _rule("vague-standard", "clause_id", "clause_id", "'vague-standard: reasonable efforts'", "FROM wordy WHERE l_partkey % 10 = 0")
    + " UNION ALL " + _rule("vague-standard", "clause_id", "obligation_id", "'vague-standard: best-efforts'", "FROM corpus_obligations WHERE ord % 4 = 0"),
)
def k8(spark, sf_dir):
    duties = model(spark, sf_dir).obligations.withColumn("standard", F.when(F.col("ord") % 4 == 0, "best-efforts"))
    return _shown(K.vague(_wordy(spark, sf_dir), duties))


@query(
    "k_one_sided_termination", "K9",
    DUTIES + """, names AS (SELECT document_id, party_id, lower(name) AS name FROM corpus_parties UNION ALL SELECT document_id, party_id, concat('supplier ', substr(party_id, 2)) FROM corpus_parties WHERE role = 'supplier'),
      hit AS (SELECT DISTINCT a.document_id, a.clause_id, n.party_id FROM corpus_a a JOIN names n ON n.document_id = a.document_id AND contains(lower(concat(a.heading, ' ', a.text)), n.name) WHERE a.l_returnflag = 'R'),
      one AS (SELECT document_id, clause_id, min(party_id) AS party FROM hit GROUP BY ALL HAVING count(*) = 1) """
    + _rule("one-sided-termination", "clause_id", "party", "concat('Termination names only ', party)", "FROM one o WHERE NOT EXISTS (SELECT 1 FROM corpus_rights r WHERE r.document_id = o.document_id AND r.clause_id = o.clause_id AND r.holder_id <> o.party)"),
)
def k9(spark, sf_dir):
    m = model(spark, sf_dir)
    known = m.parties.withColumn("aliases", F.when(F.col("role") == "supplier", F.array(F.concat(F.lit("Supplier "), F.expr("substring(id, 2)")))))
    return _shown(K.one_sided_termination(m.clauses, known, m.rights))


@query("k_renewal_without_window", "K10", ctes("corpus_a") + _rule("renewal-without-notice-window", "clause_id", "clause_id", "'Renewal without notice deadline: RENEWAL'", "FROM corpus_a WHERE l_returnflag NOT IN ('A', 'R') AND l_linenumber = 4 AND l_partkey % 2 = 0"))
def k10(spark, sf_dir):
    m = model(spark, sf_dir)
    return _shown(K.renewal_without_window(m.clauses, m.deadlines.where("date_type <> 'unspecified'"), m.conditions))


@query("k_obligation_imbalance", "K11", DUTIES + K_SQL["obligation-imbalance"])
def k11(spark, sf_dir):
    return _shown(K.imbalance(model(spark, sf_dir).obligations))


_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 5 END"


def _ranked(name: str, rules: list[str], per_rule: int, total: int) -> str:
    """SQL of the findings of rules, ranked and limited for each document, as a table of that name."""
    tie = "title, coalesce(clause_id, ''), coalesce(entity_id, '')"
    return f"""{name}_every AS ({' UNION ALL '.join(rules)}), {name}_own AS (SELECT *, row_number() OVER (PARTITION BY document_id, rule_id ORDER BY {_RANK}, {tie}) AS r FROM {name}_every),
  {name}_once AS (SELECT DISTINCT * EXCLUDE (r) FROM {name}_own WHERE r <= {per_rule}), {name}_placed AS (SELECT *, CAST(row_number() OVER (PARTITION BY document_id ORDER BY {_RANK}, rule_id, {tie}) AS INT) AS place FROM {name}_once),
  {name} AS (SELECT *, concat('f_', substr(sha256(concat_ws('|', rule_id, coalesce(clause_id, ''), coalesce(entity_id, ''), title)), 1, 12)) AS finding_id FROM {name}_placed WHERE place <= {total})"""


SIGNALS = _ranked("signals", list(K_SQL.values()), 12, 80)


def signals(spark, sf_dir, m=None):
    """The findings of the rules for risks, over a dealt model."""
    m = m or model(spark, sf_dir, dealt=True)
    return K.signals(m.clauses, m.obligations, m.deadlines, m.conditions, m.rights, m.parties, as_of(), dealt=True)


def judged(spark, sf_dir):
    """Assessed duties and risk findings of one dealt model, and the model."""
    m = model(spark, sf_dir, dealt=True)
    return D.assess(m.obligations, m.deadlines, as_of(), dealt=True), signals(spark, sf_dir, m), m


@query("risk_signals", "K12 K13", DUTIES + f", {SIGNALS} SELECT document_id, rule_id, severity, clause_id, entity_id, title, place, finding_id FROM signals")
def risk_signals(spark, sf_dir):
    return signals(spark, sf_dir).select(*_SHOWN, "place", "finding_id")


@query("risk_counts", "K13", DUTIES + f", {SIGNALS} SELECT document_id, rule_id, severity, count(*) AS n FROM signals GROUP BY ALL")
def risk_counts(spark, sf_dir):
    return rulekit.counts(signals(spark, sf_dir))


# --- inconsistency rules -----------------------------------------------------------------------


def _conflict(name: str, clause: str, entity: str, title: str, rest: str, severity: str | None = None) -> str:
    return _rule(name, clause, entity, title, rest, severity or I.RULES[name][1])


I1_SQL = _conflict(
    "conflicting-notice-periods", "a.clause_id", "b.clause_id", "concat('Notice of ', action, ': ', a.n_days, ' or ', b.n_days, ' days')",
    """FROM (SELECT x.document_id, x.action, x.a, first(s ORDER BY s.ord) AS b FROM (SELECT document_id, action, first(s ORDER BY s.ord) AS a FROM said s GROUP BY ALL) x JOIN said s ON s.document_id = x.document_id AND s.action = x.action AND s.n_days <> x.a.n_days GROUP BY ALL) z""",
)
_SAID = "said AS (SELECT document_id, ord, clause_id, n_days, CASE l_returnflag WHEN 'R' THEN 'termination' ELSE 'renewal' END AS action FROM corpus_a WHERE l_returnflag <> 'A' AND n_days BETWEEN 1 AND 365)"


@query("i_conflicting_notice", "I1", ctes("corpus_a") + f", {_SAID} {I1_SQL}")
def i1(spark, sf_dir):
    return _shown(I.conflicting_notice(model(spark, sf_dir).clauses))


_EVENTS = """k AS (SELECT d.document_id, d.deadline_id AS id, d.clause_id, d.date, CASE a.l_returnflag WHEN 'A' THEN 'the customer shall pay each invoice of the' ELSE concat('supplier ', a.l_suppkey, ' may terminate on written notice under') END AS key
      FROM corpus_deadlines d JOIN corpus_a a ON a.clause_id = d.clause_id WHERE d.date IS NOT NULL)"""
I2_SQL = _conflict(
    "contradictory-dates", "ca", "ib", "concat_ws(' ', key, CAST(a AS VARCHAR), CAST(b AS VARCHAR))",
    "FROM (SELECT document_id, key, min(date) AS a, max(date) AS b, first(clause_id ORDER BY date, id) AS ca, last(id ORDER BY date, id) AS ib FROM k GROUP BY ALL HAVING min(date) <> max(date)) z",
)


@query("i_contradictory_dates", "I2", ctes("corpus_deadlines") + f", {_EVENTS} {I2_SQL}")
def i2(spark, sf_dir):
    return _shown(I.contradictory_dates(model(spark, sf_dir).deadlines))


@query(
    "i_conflicting_terms", "I3",
    ctes("corpus_a") + _conflict("conflicting-terms", "c", "i", "concat('Defined more than once: ', key)", f"FROM (SELECT document_id, lower(heading) AS key, min(clause_id) AS c, max(clause_id) AS i FROM corpus_a GROUP BY ALL HAVING count(DISTINCT {sql_phrase('text')}) > 1) z"),
)
def i3(spark, sf_dir):
    (a,) = corpus(spark, sf_dir, "corpus_a")
    return _shown(I.conflicting_terms(a.select("document_id", "clause_id", F.col("clause_id").alias("id"), F.col("heading").alias("term"), "text")))


@query(
    "i_undefined_terms", "I4",
    _conflict("undefined-term", "CAST(document_id AS VARCHAR)", "CAST(NULL AS VARCHAR)", "concat('Not defined: ', key)",
              f"""FROM (SELECT DISTINCT document_id, {sql_phrase('t')} AS key FROM (SELECT doc_id AS document_id, unnest(regexp_extract_all(text, '"([^"\\n]{{3,60}})"', 1)) AS t FROM documents) q) z WHERE length(key) >= 4"""),
)
def i4(spark, sf_dir):
    d = documents(spark, sf_dir).withColumn("clause_id", F.col("document_id").cast("string"))
    m = model(spark, sf_dir)
    return _shown(I.undefined_terms(d, m.definitions, m.parties.where("document_id < 0")))


I5_SQL = _conflict(
    "duplicate-obligation", "a", "b", "concat('Stated more than once: ', substr(key, 1, 80))",
    f"FROM (SELECT document_id, obligor_id, {sql_phrase('summary')} AS key, min(clause_id) AS a, max(obligation_id) AS b FROM corpus_obligations GROUP BY ALL HAVING count(DISTINCT clause_id) > 1) z",
)


@query("i_duplicate_obligations", "I5", ctes("corpus_obligations") + I5_SQL)
def i5(spark, sf_dir):
    return _shown(I.duplicate_obligations(model(spark, sf_dir).obligations))


I6_SQL = _conflict(
    "missing-cross-reference", "clause_id", "CAST(NULL AS VARCHAR)", "concat('Refers to missing ', l_linenumber + 1, '.1')",
    "FROM corpus_a c WHERE l_returnflag = 'R' AND NOT EXISTS (SELECT 1 FROM corpus_a n WHERE n.document_id = c.document_id AND n.number = concat(c.l_linenumber + 1, '.1'))",
)


@query("i_missing_references", "I6", ctes("corpus_a") + I6_SQL)
def i6(spark, sf_dir):
    return _shown(I.missing_references(model(spark, sf_dir).clauses))


@query(
    "i_orphan_references", "I7",
    ctes("corpus_obligations") + _conflict("orphan-clause-reference", "CAST(NULL AS VARCHAR)", "obligation_id", "'Unknown clause gone'", "FROM corpus_obligations WHERE ord % 5 = 0")
    + " UNION ALL " + _conflict("orphan-clause-reference", "CAST(NULL AS VARCHAR)", "concat('e', obligation_id)", "'Edge with an unknown end'", "FROM corpus_obligations WHERE ord % 7 = 0"),
)
def i7(spark, sf_dir):
    m = model(spark, sf_dir)
    duties = m.obligations.select("document_id", "id", F.when(F.col("ord") % 5 == 0, "gone").otherwise(F.col("clause_id")).alias("clause_id"))
    entities = duties.unionByName(m.parties.select("document_id", "id", F.lit(None).cast("string").alias("clause_id")))
    edges = m.obligations.select("document_id", F.concat(F.lit("e"), "id").alias("id"), F.col("obligor_party_id").alias("from_id"), F.when(F.col("ord") % 7 == 0, "lost").otherwise(F.col("id")).alias("to_id"))
    return _shown(I.orphan_references(entities, m.clauses, edges))


INCONSISTENCIES = f"""{_SAID}, {_EVENTS}, {_ranked('inconsistencies', [I1_SQL, I2_SQL, I5_SQL, I6_SQL], 10, 60)}"""


def inconsistencies(spark, sf_dir, m=None):
    """The findings of the rules for inconsistencies, over a dealt model."""
    m = m or model(spark, sf_dir, dealt=True)
    entities = m.obligations.select("document_id", "id", "clause_id").unionByName(m.parties.select("document_id", "id", F.lit(None).cast("string").alias("clause_id")))
    edges = m.obligations.select("document_id", F.concat(F.lit("e"), "id").alias("id"), F.col("obligor_party_id").alias("from_id"), F.col("id").alias("to_id"))
    return I.findings(m.clauses, m.obligations, m.deadlines, m.definitions, m.parties, entities, edges, dealt=True)


@query("inconsistency_findings", "I8", DUTIES + f", {INCONSISTENCIES} SELECT document_id, rule_id, severity, clause_id, entity_id, title, place, finding_id FROM inconsistencies")
def inconsistency_findings(spark, sf_dir):
    return inconsistencies(spark, sf_dir).select(*_SHOWN, "place", "finding_id")
