"""Deadlines, duties, timelines and boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, cut, matches
from ..schemas import RECURRENCES
from ..shared import by_document

#: Duties come due within so many days, today included.
SOON_DAYS = 30
#: Most steps of a recurrence.
MOST_STEPS = 400
STATUSES = ["overdue", "due", "upcoming", "conditional", "informational", "unknown"]
BUCKETS = ["past", "due-soon", "future", "undated"]


def add_period(start: Column, amount: Column, unit: Column) -> Column:
    """O1: a date plus days, weeks, months or years; where a month lacks the day, it runs on into the next."""
    months = F.when(unit == "year", amount * 12).otherwise(amount)
    run_on = F.date_add(F.add_months(F.trunc(start, "month"), months.cast("int")), F.dayofmonth(start) - 1)
    days = F.when(unit == "week", amount * 7).otherwise(amount)
    return F.when(unit.isin("day", "week"), F.date_add(start, days.cast("int"))).when(unit.isin("month", "year"), run_on)


def next_occurrence(anchor: Column, recurrence: Column, as_of: Column, most: int = MOST_STEPS) -> Column:
    """The first date of a recurrence on or after ``as_of``, or that after ``most`` steps; null for an unknown recurrence.

    Days are counted at once. Months are stepped through one by one, because each step runs on from
    the one before where a month lacks the day.
    """
    step = lambda n: lambda at, _: F.when(at < as_of, add_period(at, F.lit(n), F.lit("month"))).otherwise(at)
    out = F.when(F.lit(False), anchor)
    for name, (n, unit) in RECURRENCES.items():
        if unit == "day":
            steps = F.least(F.lit(most), F.greatest(F.lit(0), F.ceil(F.datediff(as_of, anchor) / n)))
            value = F.date_add(anchor, (steps * n).cast("int"))
        else:
            value = F.aggregate(F.sequence(F.lit(1), F.lit(most)), anchor, step(n))
        out = out.when(F.lower(recurrence) == name, value)
    return out


def resolve(deadlines: DataFrame, as_of: Column, effective: DataFrame | None = None) -> DataFrame:
    """O2: ``resolved_date`` and ``reason``: a stated date, a recurrence, an offset from the anchor, or why there is none.

    A recurrence counts for deadlines of type ``recurring`` only. Without an anchor date the
    document's ``effective(document_id, effective_date)`` is the anchor.
    """
    c = F.col
    rows = deadlines.join(effective.select("document_id", "effective_date"), "document_id", "left") if effective is not None else deadlines.withColumn("effective_date", F.lit(None).cast("date"))
    anchor = F.coalesce("anchor_date", "effective_date")
    recurring = (c("date_type") == "recurring") & (F.coalesce("recurrence", F.lit("")) != "")
    has_offset = (F.coalesce("offset_amount", F.lit(0)) != 0) & c("offset_unit").isNotNull()
    date = (
        F.when(c("date").isNotNull(), c("date"))
        .when(recurring, next_occurrence(anchor, c("recurrence"), as_of))
        .when(has_offset, add_period(anchor, c("offset_amount"), c("offset_unit")))
    )
    reason = F.when(c("resolved_date").isNotNull(), None).when(recurring, "no-start-or-unit").when(has_offset, "no-anchor-date").otherwise("no-date-stated")
    return rows.withColumn("resolved_date", date).withColumn("reason", reason).drop("effective_date")


def status(informational: Column, has_trigger: Column, due: Column, as_of: Column, soon: int = SOON_DAYS) -> Column:
    """O3: the state of a duty on a day; without a date it is conditional if a condition triggers it, else unknown."""
    left = F.datediff(due, as_of)
    return (
        F.when(informational, "informational")
        .when(due.isNull(), F.when(has_trigger, "conditional").otherwise("unknown"))
        .when(left < 0, "overdue")
        .when(left <= soon, "due")
        .otherwise("upcoming")
    )


def assess(obligations: DataFrame, deadlines: DataFrame, as_of: Column, effective: DataFrame | None = None, dealt: bool = False) -> DataFrame:
    """Duties with their resolved date, days left, status, and whether their deadline is there. Of ``dealt`` tables nothing is dealt out again."""
    dated = resolve(deadlines, as_of, effective).select("document_id", F.col("id").alias("deadline_id"), "resolved_date", F.lit(True).alias("found"))
    if dealt:
        # Duties meet their deadlines by a window and not by a join, for which dealt rows would be dealt out again.
        key = ["document_id", "deadline_id"]
        duties = obligations.select(*key, F.struct(*[c for c in obligations.columns if c not in key]).alias("duty"))
        met = by_document(duties.unionByName(dated.where("document_id is not null and deadline_id is not null").select(*key, F.struct("resolved_date", "found").alias("date")), allowMissingColumns=True), dealt)
        met = met.withColumn("dates", F.collect_list("date").over(Window.partitionBy("deal", *key))).where("duty is not null")
        out = met.select(*key, "duty.*", F.explode_outer(F.when(F.col("deadline_id").isNotNull(), F.col("dates"))).alias("date")).select("*", "date.*").drop("date")
    else:
        out = obligations.join(dated, ["document_id", "deadline_id"], "left")
    informational = F.coalesce("informational", F.lit(False)) | (F.coalesce("standard", F.lit("")) == "informational")
    state = status(informational, F.col("trigger_condition_id").isNotNull(), F.col("resolved_date"), as_of)
    left = F.when(~informational, F.datediff("resolved_date", as_of))
    return out.withColumn("status", state).withColumn("days_left", left).withColumn("deadline_found", F.coalesce("found", F.lit(False))).drop("found")


def linked_consequences(obligations: DataFrame, consequences: DataFrame, null_matches_null: bool = False) -> DataFrame:
    """Consequences of a duty, by id or by the same trigger; two missing triggers are the same only on request."""
    by_id = obligations.select("document_id", "id", F.explode("consequence_ids").alias("consequence_id"))
    known = consequences.select("document_id", F.col("id").alias("consequence_id"), F.col("trigger_condition_id").alias("trigger"))
    by_id = by_id.join(known, ["document_id", "consequence_id"]).select("document_id", "id", "consequence_id")
    duty = obligations.select("document_id", "id", F.col("trigger_condition_id").alias("mine"))
    same = F.col("mine").eqNullSafe(F.col("trigger")) if null_matches_null else F.col("mine") == F.col("trigger")
    by_trigger = duty.join(known, "document_id").where(same).select("document_id", "id", "consequence_id")
    return by_id.unionByName(by_trigger).distinct()


def bucket(due: Column, as_of: Column, soon: int = SOON_DAYS) -> Column:
    """Where a date stands in the timeline."""
    left = F.datediff(due, as_of)
    return F.when(due.isNull(), "undated").when(left < 0, "past").when(left <= soon, "due-soon").otherwise("future")


def timeline(deadlines: DataFrame, obligations: DataFrame, as_of: Column) -> DataFrame:
    """One row a deadline with bucket and the last duty that names it, in order of date."""
    last = obligations.where("deadline_id is not null").groupBy("document_id", "deadline_id").agg(F.max_by("id", "ord").alias("obligation_id"))
    out = resolve(deadlines, as_of).join(last.withColumnRenamed("deadline_id", "id"), ["document_id", "id"], "left")
    order = Window.partitionBy("document_id").orderBy(F.col("resolved_date").asc_nulls_last(), "id")
    return out.withColumn("bucket", bucket(F.col("resolved_date"), as_of)).withColumn("place", F.row_number().over(order))


def count_by(rows: DataFrame, column: str, values: list[str], *keys: str) -> DataFrame:
    """Counts of each value of a vocabulary, zeros included, for each key."""
    spark = rows.sparkSession
    words = spark.createDataFrame([(v,) for v in values], f"{column} string")
    counted = rows.groupBy(*keys, column).agg(F.count("*").alias("n"))
    grid = rows.select(*keys).distinct().withColumn(column, F.explode(F.array(*[F.lit(v) for v in values]))) if keys else words
    return grid.join(counted, [*keys, column], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def kind(clause_type: Column, *texts: Column) -> Column:
    """What a deadline is about."""
    # Wordings of each kind.
    scope = collapse(F.concat_ws(" ", *texts))
    words = {
        "payment": r"invoice|payment|pay |fees?|remuneration|salary|interest|refund|deposit",
        "renewal": r"renew|extension|successive term|further term",
        "notice": r"notice|notify|notification",
        "termination": r"terminat|expiry|expire|end of (?:the )?term|cancel",
    }
    said = {k: matches(scope, [p]) for k, p in words.items()}
    return (
        F.when((clause_type == "renewal") | said["renewal"], "renewal")
        .when((clause_type == "termination") & said["termination"], "termination")
        .when((clause_type == "payment") | said["payment"], "payment")
        .when((clause_type == "notice") | said["notice"], "notice")
        .when(said["termination"], "termination")
        .otherwise("deadline")
    )


def by_party(assessed: DataFrame) -> DataFrame:
    """Duties of each party and status; ``unassigned`` where no party is named."""
    return assessed.groupBy("document_id", F.coalesce("obligor_party_id", F.lit("unassigned")).alias("party_id"), "status").agg(F.count("*").alias("duties"))


def party_options(assessed: DataFrame, parties: DataFrame) -> DataFrame:
    """Parties to filter a board by, most duties first, then by name."""
    n = assessed.where("obligor_party_id is not null").groupBy("document_id", F.col("obligor_party_id").alias("party_id")).agg(F.count("*").alias("duties"))
    named = n.join(parties.select("document_id", F.col("id").alias("party_id"), "name"), ["document_id", "party_id"], "left").withColumn("name", F.coalesce("name", "party_id"))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy(F.desc("duties"), "name", "party_id")))


def board(assessed: DataFrame) -> DataFrame:
    """Seven counters of a document's duties."""
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    return assessed.groupBy("document_id").agg(
        F.count("*").alias("total"), n("overdue").alias("overdue"), n("due").alias("due"), n("upcoming").alias("upcoming"),
        n("conditional").alias("conditional"), n("unknown").alias("undated"), n("informational").alias("informational"),
    )


def rights_board(rights: DataFrame, obligations: DataFrame, most: int = 6) -> DataFrame:
    """Up to ``most`` duties related to each right: in its clause, or owed by its counterparty; each once."""
    r = rights.select("document_id", F.col("id").alias("right_id"), "clause_id", F.col("counterparty_party_id").alias("obligor_party_id"))
    o = obligations.select("document_id", F.col("id").alias("obligation_id"), "ord", "clause_id", "obligor_party_id")
    cols = ["document_id", "right_id", "obligation_id", "ord"]
    same_clause = r.join(o.drop("obligor_party_id"), ["document_id", "clause_id"]).select(cols)
    same_party = r.join(o.drop("clause_id"), ["document_id", "obligor_party_id"]).select(cols)
    both = same_clause.unionByName(same_party).distinct()
    ranked = both.withColumn("place", F.row_number().over(Window.partitionBy("document_id", "right_id").orderBy("ord", "obligation_id")))
    return ranked.where(F.col("place") <= most).drop("ord")


def excerpt(text: Column, most: int = 180) -> Column:
    """A clause on one line, cut."""
    return cut(collapse(text), most)


def due_in(days: Column) -> Column:
    """Days as words."""
    n = F.abs(days)
    unit = F.when(n == 1, " day").otherwise(" days")
    return F.when(days.isNull(), "no date").when(days == 0, "today").when(days > 0, F.concat(F.lit("in "), n.cast("string"), unit)).otherwise(F.concat(n.cast("string"), unit, F.lit(" ago")))
