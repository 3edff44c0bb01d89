"""Risk rules over the contract model.

Tables: ``clauses(document_id, clause_id, heading, text, clause_type)``, ``obligations``, ``deadlines``
and so on with ``id``. A rule is a filter or an anti-join that yields findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import PERIOD, collapse, cut, first_match, matches, period
from ..shared import by_document, written
from . import rulekit
from .deadlines import resolve

# The wordings of each rule.
PATTERNS = {
    "unlimited-liability": [
        r"unlimited liability",
        r"no limit(?:ation)? (?:of|on|to) liability",
        r"liability (?:shall|will) not be limited",
        r"not be limited in (?:amount|any (?:way|respect))",
        r"without (?:any )?limit(?:ation)? of liability",
    ],
    "automatic-renewal": [
        r"automatically renew",
        r"auto-renew",
        r"renews? (?:automatically|for (?:a )?further|for successive|for additional)",
        r"successive (?:term|period)s? (?:of|unless)",
    ],
    "broad-discretion": [
        r"sole (?:and absolute )?discretion",
        r"at (?:its|their|his|her) (?:sole )?discretion",
        r"as (?:it|they) (?:sees? fit|deems (?:appropriate|necessary|fit))",
        r"may determine (?:in its|at its|unilaterally)",
    ],
    "vague-standard": [
        r"reasonable (?:efforts|endeavours|endeavors)",
        r"best (?:efforts|endeavours|endeavors)",
        r"as soon as (?:reasonably )?practicable",
        r"from time to time",
        r"materially",
    ],
    "termination-act": [r"may (?:terminate|suspend|cease)", r"shall be entitled to terminate", r"right to terminate"],
}
# Words of notice, standards that qualify a duty, and category and severity of each rule.
NOTICE = r"notice|notify|notification"
QUALIFIED = ["best-efforts", "reasonable-efforts", "commercially-reasonable"]
RULES = {
    "obligation-without-deadline": ("ambiguity", "medium"), "obligation-without-consequence": ("missing-remedy", "low"), "deadline-unresolvable": ("ambiguity", "medium"),
    "short-notice-period": ("short-notice-period", "medium"), "unlimited-liability": ("unlimited-liability", "high"), "automatic-renewal": ("auto-renewal", "medium"),
    "renewal-without-notice-window": ("auto-renewal", "medium"), "vague-standard": ("ambiguity", "low"), "broad-discretion": ("broad-discretion", "low"),
    "one-sided-termination": ("one-sidedness", "medium"), "obligation-imbalance": ("one-sidedness", "low"),
}


def clause_scope(heading: str = "heading", text: str = "text") -> Column:
    """What a rule reads of a clause."""
    return collapse(F.concat_ws(" ", heading, text))


def _make(rows: DataFrame, rule: str, title: Column, clause: Column | None = None, entity: Column | None = None) -> DataFrame:
    return rulekit.finding(rows, rule, *RULES[rule], title, clause, entity)


def _duty_rules() -> dict[str, tuple[Column, Column]]:
    """K1, K2, K8: rules that look at one duty: whether it breaks each, and the title."""
    binding, blank = ~F.coalesce("informational", F.lit(False)), lambda c: F.coalesce(c, F.lit("")) == ""
    return {
        "obligation-without-deadline": (binding & F.col("deadline_id").isNull() & F.col("trigger_condition_id").isNull() & blank("trigger_text"), F.concat(F.lit("No timing: "), cut(F.col("summary"), 80))),
        "obligation-without-consequence": (binding & (F.coalesce(F.size("consequence_ids"), F.lit(0)) <= 0) & blank("consequence_text"), F.concat(F.lit("No consequence: "), cut(F.col("summary"), 80))),
        "vague-standard": (F.col("standard").isin(QUALIFIED), F.concat(F.lit("vague-standard: "), F.col("standard"))),
    }


def _duties(obligations: DataFrame, rule: str) -> DataFrame:
    breaks, title = _duty_rules()[rule]
    return _make(obligations.where(breaks), rule, title, F.col("clause_id"), F.col("id"))


def without_deadline(obligations: DataFrame) -> DataFrame:
    """K1: no deadline and nothing that triggers the duty."""
    return _duties(obligations, "obligation-without-deadline")


def without_consequence(obligations: DataFrame) -> DataFrame:
    """K2: no consequence by id or wording."""
    return _duties(obligations, "obligation-without-consequence")


def of_duties(obligations: DataFrame) -> DataFrame:
    """K1, K2, K8: all rules that look at one duty, each duty read once for all of them."""
    tried = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(RULES[r][0]).alias("category"), F.lit(RULES[r][1]).alias("severity"), title.alias("title"), F.coalesce(breaks, F.lit(False)).alias("breaks")) for r, (breaks, title) in _duty_rules().items()])
    hits = obligations.select("document_id", F.col("clause_id").cast("string").alias("clause_id"), F.col("id").cast("string").alias("entity_id"), F.inline(F.filter(tried, lambda t: t["breaks"])))
    return hits.select(rulekit.COLUMNS)


def unresolvable(deadlines: DataFrame, as_of: Column) -> DataFrame:
    """K3: a deadline that no calendar date follows from."""
    rows = resolve(deadlines, as_of).where("resolved_date is null and reason is not null")
    return _make(rows, "deadline-unresolvable", F.concat(F.lit("No date: "), cut(F.col("description"), 80)), F.col("clause_id"), F.col("id"))


def short_notice(deadlines: DataFrame, clauses: DataFrame, threshold: int = 30, dealt: bool = False) -> DataFrame:
    """K4: the shortest exact period below ``threshold`` days where notice is spoken of, the first of equals."""
    said = F.concat_ws(" ", "description", F.coalesce("event", F.lit("")), F.coalesce("anchor_event", F.lit("")))
    spoken = deadlines.select("document_id", "clause_id", F.struct("id", said.alias("said")).alias("d"))
    scopes = clauses.where("document_id is not null and clause_id is not null").select("document_id", "clause_id", clause_scope().alias("scope"))
    # Deadlines meet their clauses by a window and not by a join, for which dealt rows would be dealt out again.
    met = by_document(spoken.unionByName(scopes, allowMissingColumns=True), dealt)
    met = met.withColumn("scopes", F.collect_list("scope").over(Window.partitionBy("deal", "document_id", "clause_id"))).where("d is not null")
    met = met.select("document_id", "d.id", "clause_id", "d.said", F.explode_outer(F.when(F.col("clause_id").isNotNull(), F.col("scopes"))).alias("scope"))
    rows = met.withColumn("scope", collapse(F.concat_ws(" ", "said", "scope"))).where(matches(F.col("scope"), [NOTICE]))
    # Found texts are rows before they are read: what stands inside a lambda is interpreted.
    rows = rows.select("document_id", "id", "clause_id", F.posexplode(F.regexp_extract_all("scope", F.lit(PERIOD), F.lit(0))).alias("at", "found")).withColumn("p", period(F.col("found")))
    rows = rows.where(F.col("p.exact") & (F.col("p.n_days") > 0) & (F.col("p.n_days") < threshold))
    best = rows.groupBy("document_id", "id", "clause_id").agg(F.min_by("p", F.struct("p.n_days", "at")).alias("p"))
    return _make(best, "short-notice-period", F.concat(F.lit("Notice period of "), F.col("p.phrase")), F.col("clause_id"), F.col("id"))


def wordings(clauses: DataFrame, rules: list[str]) -> DataFrame:
    """K5 to K8: clauses with the wording of one of the rules, each clause read once for all of them; the title holds the words found."""
    read = clauses.select("document_id", "clause_id", clause_scope().alias("scope"))
    # One look tells clauses without any of a rule's wordings.
    tried = F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(RULES[r][0]).alias("category"), F.lit(RULES[r][1]).alias("severity"), F.when(matches(F.col("scope"), PATTERNS[r]), first_match(F.col("scope"), PATTERNS[r])).alias("found")) for r in rules])
    hits = read.select("document_id", "clause_id", F.inline(F.filter(tried, lambda t: t["found"].isNotNull())))
    title = F.concat("rule_id", F.lit(": "), F.lower("found"))
    return hits.select("document_id", "rule_id", "category", "severity", F.col("clause_id").cast("string").alias("clause_id"), F.col("clause_id").cast("string").alias("entity_id"), title.alias("title"))


def worded(clauses: DataFrame, rule: str) -> DataFrame:
    """K5 to K7: clauses with a rule's wording."""
    return wordings(clauses, [rule])


def qualified(obligations: DataFrame) -> DataFrame:
    """K8: duties with a qualified standard."""
    return _duties(obligations, "vague-standard")


def vague(clauses: DataFrame, obligations: DataFrame) -> DataFrame:
    """K8: qualified standards of duties, and clauses with such wording."""
    return worded(clauses, "vague-standard").unionByName(qualified(obligations))


def mentions(clauses: DataFrame, parties: DataFrame) -> DataFrame:
    """Parties whose name or an alias occurs in a clause; equality on the document keeps the join local."""
    names = parties.select("document_id", F.col("id").alias("party_id"), F.explode(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name")).where(F.length("name") > 2)
    hit = clauses.select("document_id", "clause_id", F.lower(clause_scope()).alias("scope")).join(names, "document_id").where(F.contains(F.col("scope"), F.lower("name")))
    return hit.select("document_id", "clause_id", "party_id").distinct()


def one_sided_termination(clauses: DataFrame, parties: DataFrame, rights: DataFrame, dealt: bool = False) -> DataFrame:
    """K9: termination wording with one party named and no right of another in the clause."""
    acts = clauses.where("document_id is not null and clause_id is not null").where(matches(clause_scope(), PATTERNS["termination-act"]))
    named = mentions(acts, parties)
    one = named.groupBy("document_id", "clause_id").agg(F.count("*").alias("n"), F.min("party_id").alias("party_id")).where("n = 1").drop("n")
    held = rights.where("holder_party_id is not null").select("document_id", "clause_id", F.col("holder_party_id").alias("holder"))
    met = by_document(one.unionByName(held, allowMissingColumns=True), dealt)
    met = met.withColumn("holders", F.collect_set("holder").over(Window.partitionBy("deal", "document_id", "clause_id"))).where("party_id is not null")
    alone = met.where(F.size(F.array_remove("holders", F.col("party_id"))) == 0)
    return _make(alone, "one-sided-termination", F.concat(F.lit("Termination names only "), F.col("party_id")), F.col("clause_id"), F.col("party_id"))


def renewal_without_window(clauses: DataFrame, deadlines: DataFrame, conditions: DataFrame, dealt: bool = False) -> DataFrame:
    """Renewal clauses without a deadline and without a renewal, termination or notice condition."""
    key = ["document_id", "clause_id"]
    renewals = clauses.where((F.col("clause_type") == "renewal") | matches(F.col("heading"), ["renew"])).select(*key, F.struct(F.coalesce("heading", "number").alias("name")).alias("renewal"))
    guarded = conditions.where(F.col("condition_type").isin("renewal", "termination", "notice"))
    met = by_document(renewals.unionByName(deadlines.select(key), allowMissingColumns=True).unionByName(guarded.select(key), allowMissingColumns=True), dealt)
    guard = F.max(F.col("renewal").isNull()).over(Window.partitionBy("deal", *key))
    open_ = met.withColumn("guard", guard & F.col("document_id").isNotNull() & F.col("clause_id").isNotNull()).where("renewal is not null and not guard")
    return _make(open_, "renewal-without-notice-window", F.concat(F.lit("Renewal without notice deadline: "), F.col("renewal.name")), F.col("clause_id"), F.col("clause_id"))


def imbalance(obligations: DataFrame, least: int = 3, factor: int = 3) -> DataFrame:
    """Duties that fall on one party: all of them, or ``factor`` times those of the next."""
    n = obligations.where("obligor_party_id is not null").groupBy("document_id", "obligor_party_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("document_id").orderBy(F.desc("n"), "obligor_party_id")
    whole = Window.partitionBy("document_id")
    top = n.withColumn("r", F.row_number().over(w)).withColumn("next", F.coalesce(F.lead("n").over(w), F.lit(0))).withColumn("total", F.sum("n").over(whole)).where("r = 1")
    rows = top.where((F.col("total") >= least) & ((F.col("next") == 0) | (F.col("n") >= F.col("next") * factor)))
    title = F.concat(F.col("obligor_party_id"), F.lit(" carries "), F.col("n").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" duties"))
    return _make(rows, "obligation-imbalance", title, None, F.col("obligor_party_id"))


def signals(clauses: DataFrame, obligations: DataFrame, deadlines: DataFrame, conditions: DataFrame, rights: DataFrame, parties: DataFrame, as_of: Column, per_rule: int = 12, total: int = 80, dealt: bool = False) -> DataFrame:
    """All rules, ranked and limited for each document.

    Tables that several rules read are derived once, and every clause is read once for all wordings.
    Of ``dealt`` tables, whose rows lie by document, nothing is written or dealt out again.
    """
    if not dealt:
        clauses, obligations, deadlines = written(clauses, "clauses"), written(obligations, "obligations"), written(deadlines, "deadlines")
    found = [
        of_duties(obligations), unresolvable(deadlines, as_of), short_notice(deadlines, clauses, dealt=dealt),
        wordings(clauses, ["unlimited-liability", "automatic-renewal", "broad-discretion", "vague-standard"]),
        one_sided_termination(clauses, parties, rights, dealt), renewal_without_window(clauses, deadlines, conditions, dealt), imbalance(obligations),
    ]
    return rulekit.run(found, per_rule, total, dealt)


def with_provider(findings: DataFrame, provider: DataFrame) -> DataFrame:
    """Our findings and a provider's ``(document_id, id, clause_id, category, severity, title)`` as one table."""
    theirs = rulekit.finding(provider, "provider", "", F.col("severity"), F.col("title"), F.col("clause_id"), F.col("id")).drop("category")
    theirs = theirs.join(provider.select("document_id", F.col("id").alias("entity_id"), "category"), ["document_id", "entity_id"])
    return findings.select(*rulekit.COLUMNS).unionByName(theirs.select(*rulekit.COLUMNS))


def of_entity(findings: DataFrame, entity_id: str) -> DataFrame:
    """Findings that are about an entity."""
    return findings.where((F.col("entity_id") == entity_id) | (F.col("clause_id") == entity_id))


def by_category(findings: DataFrame) -> DataFrame:
    """Finding ids of each category, in order."""
    return findings.groupBy("document_id", "category").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "finding_id"))), lambda s: s["finding_id"]).alias("finding_ids"))
