"""Version comparison (D1 to D21) and reach of changes (M1 to M5).

Tables of a comparison carry ``pair`` as key in the place of the document.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import phrase, question_terms
from ..shipping import ship

# The fields that are compared, by entity type.
FIELDS = {
    "clause": ["number", "heading", "text", "clause_type"],
    "party": ["name", "role"],
    "obligation": ["summary", "obligor_party_id", "obligee_party_id", "deadline_id", "informational"],
    "right": ["summary", "holder_party_id", "counterparty_party_id"],
    "deadline": ["description", "date", "date_type", "offset_amount", "offset_unit"],
}
CHANGES = ["added", "removed", "modified", "unchanged"]


def canonical(value: Column, kind: str = "string") -> Column:
    """The form in which two values are compared."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(F.array_sort(F.transform(value.cast("array<string>"), phrase)), "|"), F.lit(""))
    return phrase(value.cast("string"))


def match(a: DataFrame, b: DataFrame, key: Column, keep: list[str], by: str = "document_id") -> DataFrame:
    """Pairs of two versions' entities: by id, then by a natural key that one leftover on each side has; the rest alone.

    Returns ``(by, id_a, id_b, <keep>_a, <keep>_b)``.
    """
    cols = [by, "id", *keep]
    left = a.withColumn("k", key).select(*cols, "k").select(by, F.col("id").alias("id_a"), *(F.col(c).alias(f"{c}_a") for c in keep), F.col("k").alias("k_a"))
    right = b.withColumn("k", key).select(*cols, "k").select(by, F.col("id").alias("id_b"), *(F.col(c).alias(f"{c}_b") for c in keep), F.col("k").alias("k_b"))
    full = left.withColumn("id", F.col("id_a")).join(right.withColumn("id", F.col("id_b")), [by, "id"], "full").drop("id")
    both = full.where("id_a is not null and id_b is not null").drop("k_a", "k_b")
    only_a, only_b = full.where("id_b is null").select(left.columns), full.where("id_a is null").select(right.columns)
    single = lambda df, k: df.where(F.col(k) != "").withColumn("same", F.count("*").over(Window.partitionBy(by, k)))
    one_a, one_b = single(only_a, "k_a").where("same = 1").drop("same"), single(only_b, "k_b").where("same = 1").drop("same")
    by_key = one_a.withColumn("k", F.col("k_a")).join(one_b.withColumn("k", F.col("k_b")), [by, "k"]).drop("k", "k_a", "k_b")
    rest_a = only_a.drop("k_a").join(by_key.select(by, "id_a"), [by, "id_a"], "left_anti")
    rest_b = only_b.drop("k_b").join(by_key.select(by, "id_b"), [by, "id_b"], "left_anti")
    return both.unionByName(by_key).unionByName(rest_a, allowMissingColumns=True).unionByName(rest_b, allowMissingColumns=True)


def field_changes(matched: DataFrame, fields: list[str], by: str = "document_id") -> DataFrame:
    """D3: ``(by, id_a, id_b, field, before, after)`` of the fields that differ in a pair."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"{f}_a").cast("string").alias("before"), F.col(f"{f}_b").cast("string").alias("after")) for f in fields])
    pairs = matched.where("id_a is not null and id_b is not null").select(by, "id_a", "id_b", F.explode(each).alias("c"))
    return pairs.select(by, "id_a", "id_b", "c.*").where(canonical(F.col("before")) != canonical(F.col("after")))


def classify(matched: DataFrame, fields: list[str]) -> DataFrame:
    """``change`` of each pair."""
    differs = reduce(lambda acc, f: acc | (canonical(F.col(f"{f}_a")) != canonical(F.col(f"{f}_b"))), fields, F.lit(False))
    change = F.when(F.col("id_a").isNull(), "added").when(F.col("id_b").isNull(), "removed").when(differs, "modified").otherwise("unchanged")
    return matched.withColumn("change", change)


def edge_changes(a: DataFrame, b: DataFrame, by: str = "document_id") -> DataFrame:
    """Edges by type and start: equal targets pair up; what is left pairs by place and is changed; the rest is added or removed."""
    group = [by, "type", "from_id"]
    la, lb = a.select(*group, "to_id").distinct(), b.select(*group, "to_id").distinct()
    rest_a, rest_b = la.join(lb, [*group, "to_id"], "left_anti"), lb.join(la, [*group, "to_id"], "left_anti")
    place = F.row_number().over(Window.partitionBy(*group).orderBy("to_id"))
    ra = rest_a.withColumn("place", place).withColumnRenamed("to_id", "to_a")
    rb = rest_b.withColumn("place", place).withColumnRenamed("to_id", "to_b")
    full = ra.join(rb, [*group, "place"], "full")
    change = F.when(F.col("to_a").isNull(), "added").when(F.col("to_b").isNull(), "removed").otherwise("changed")
    return full.select(*group, "to_a", "to_b", change.alias("change"))


def node_changes(a: DataFrame, b: DataFrame, fields: list[str], by: str = "document_id") -> DataFrame:
    """Graph nodes by id, then by type and label in order of place; pairs of the second kind are always changed."""
    keep = [by, "id", "entity_type", "label", *fields]
    la = a.select(*dict.fromkeys(keep))
    lb = b.select(*dict.fromkeys(keep))
    names = [c for c in la.columns if c not in (by, "id")]
    xa = la.select(by, "id", *(F.col(c).alias(f"{c}_a") for c in names), F.lit(True).alias("in_a"))
    xb = lb.select(by, "id", *(F.col(c).alias(f"{c}_b") for c in names), F.lit(True).alias("in_b"))
    full = xa.join(xb, [by, "id"], "full")
    differs = reduce(lambda acc, f: acc | (canonical(F.col(f"{f}_a")) != canonical(F.col(f"{f}_b"))), names, F.lit(False))
    same = full.where("in_a and in_b").select(by, F.col("id").alias("id_a"), F.col("id").alias("id_b"), F.when(differs, "changed").otherwise("unchanged").alias("change"))
    place = lambda s: F.row_number().over(Window.partitionBy(by, f"entity_type_{s}", f"label_{s}").orderBy("id"))
    oa = full.where("in_b is null").withColumn("place", place("a")).select(by, F.col("entity_type_a").alias("t"), F.col("label_a").alias("l"), "place", F.col("id").alias("id_a"))
    ob = full.where("in_a is null").withColumn("place", place("b")).select(by, F.col("entity_type_b").alias("t"), F.col("label_b").alias("l"), "place", F.col("id").alias("id_b"))
    rest = oa.join(ob, [by, "t", "l", "place"], "full")
    change = F.when(F.col("id_a").isNull(), "added").when(F.col("id_b").isNull(), "removed").otherwise("changed")
    return same.unionByName(rest.select(by, "id_a", "id_b", change.alias("change")))


def totals(changes: DataFrame, by: str = "document_id") -> DataFrame:
    """Changes by kind."""
    return changes.groupBy(by, "change").agg(F.count("*").alias("n"))


def clause_citations(clauses: DataFrame, facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """The quotes of each clause: its own, and those of every fact that hangs off it by its clause or by a quote.

    ``(document_id, of_clause, clause_id, source_text, start_offset, id)``; of quotes with the same place and
    text the smallest ``id`` stands. A quote without a clause counts where its fact hangs.
    """
    cited = evidence.select("document_id", F.col("entity_id").alias("id"), "clause_id").join(facts.select("document_id", "id"), ["document_id", "id"], "left_semi")
    own = clauses.select("document_id", F.col("clause_id").alias("id"), "clause_id")
    hung = facts.select("document_id", "id", "clause_id").unionByName(cited).unionByName(own).where("clause_id is not null").distinct()
    pairs = hung.select("document_id", F.col("id").alias("entity_id"), F.col("clause_id").alias("of_clause"))
    return pairs.join(evidence, ["document_id", "entity_id"]).groupBy("document_id", "of_clause", "clause_id", "source_text", "start_offset").agg(F.min("id").alias("id"))


def period_change(before: Column, after: Column) -> Column:
    """Whether a period in days became shorter or longer."""
    return F.when(before == after, "same").when(after < before, "shortened").when(after > before, "extended").when(before.isNull() & after.isNotNull(), "stated").when(after.isNull() & before.isNotNull(), "dropped").otherwise("same")


def count_changes(changes: DataFrame, scopes: list[str], by: list[str]) -> DataFrame:
    """A row for each scope with a column for each kind of change, zeros included."""
    grid = changes.select(*by).distinct().withColumn("scope", F.explode(F.array(*[F.lit(s) for s in scopes])))
    wide = changes.groupBy(*by, "scope").pivot("change", CHANGES).agg(F.count(F.lit(1)))
    return grid.join(wide, [*by, "scope"], "left").na.fill(0, CHANGES)


def structure_changes(a: DataFrame, b: DataFrame, by: str = "document_id") -> DataFrame:
    """Facts ``(by, kind, subject, ord, value)`` of two versions; of facts with one subject the last counts."""
    last = lambda df, s: df.groupBy(by, "kind", "subject").agg(F.max_by("value", "ord").alias(s))
    full = last(a, "before").withColumn("in_a", F.lit(True)).join(last(b, "after").withColumn("in_b", F.lit(True)), [by, "kind", "subject"], "full")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "unchanged").otherwise("modified")
    return full.select(by, "kind", "subject", "before", "after", change.alias("change"))


def risk_shift(changes: DataFrame, by: str = "document_id") -> DataFrame:
    """What a comparison means for the reader: ``changes(by, scope, change, direction)`` to signals with counts, or ``neutral``."""
    signal = (
        F.when((F.col("scope") == "deadline") & (F.col("direction") == "shortened"), "deadlines-shortened")
        .when((F.col("scope") == "deadline") & (F.col("direction") == "extended"), "deadlines-extended")
        .when((F.col("scope") == "obligation") & (F.col("change") == "added"), "obligations-added")
        .when((F.col("scope") == "obligation") & (F.col("change") == "removed"), "obligations-removed")
        .when((F.col("scope") == "consequence") & F.col("change").isin("added", "modified"), "consequences-changed")
        .when((F.col("scope") == "right") & (F.col("change") == "removed"), "rights-removed")
    )
    found = changes.withColumn("signal", signal).where("signal is not null").groupBy(by, "signal").agg(F.count("*").alias("n"))
    calm = changes.select(by).distinct().join(found, by, "left_anti").select(by, F.lit("neutral").alias("signal"), F.lit(0).cast("long").alias("n"))
    return found.unionByName(calm)


def diff_words(before: str, after: str, most: int = 800) -> list[tuple[str, str]]:
    """Runs of equal, removed and added words by a longest common subsequence; removals first; beyond ``most`` words a block each."""
    a, b = (before or "").split(), (after or "").split()
    if len(a) > most or len(b) > most:
        return [(k, " ".join(w)) for k, w in (("removed", a), ("added", b)) if w]
    fold = lambda w: "".join(c for c in w.lower() if c.isalnum())
    ka, kb = [fold(w) or w for w in a], [fold(w) or w for w in b]
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    codes = {w: i for i, w in enumerate(dict.fromkeys(ka + kb))}
    cb = np.array([codes[w] for w in kb], np.int64)
    for i in range(len(a) - 1, -1, -1):
        diagonal = np.where(cb == codes[ka[i]], best[i + 1, 1:] + 1, 0)
        # A cell is the best of below, right and, where the words are equal, the diagonal.
        row = np.maximum(best[i + 1, :-1], diagonal)
        best[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    out: list[list] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and ka[i] == kb[j]:
            kind, word, i, j = "equal", b[j], i + 1, j + 1
        elif i < len(a) and (j == len(b) or best[i + 1, j] >= best[i, j + 1]):
            kind, word, i = "removed", a[i], i + 1
        else:
            kind, word, j = "added", b[j], j + 1
        if out and out[-1][0] == kind:
            out[-1][1].append(word)
        else:
            out.append([kind, [word]])
    return [(k, " ".join(w)) for k, w in out]


def word_diff(pairs: DataFrame, before: str = "before", after: str = "after", most: int = 800) -> DataFrame:
    """``pairs`` with ``parts``, the runs of the word difference; equal texts are not looked into."""
    ship(pairs.sparkSession)

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def parts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in batches:
            yield pd.Series([[{"kind": k, "text": t} for k, t in diff_words(x, y, most)] for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("parts", parts(F.col(before), F.col(after)))


def shared_terms(a: Column, b: Column, most: int = 8) -> Column:
    """Distinct words over three letters that both texts have, the first of them in the order of the first."""
    words = lambda t: F.array_distinct(F.filter(F.split(phrase(t), " "), lambda w: F.length(w) > 3))
    return F.slice(F.array_intersect(words(a), words(b)), 1, most)


def links(tables: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """M2: undirected links from foreign keys ``(table, from column, to column, via)``; of equal links the first table's ``via``."""
    each = []
    for rank, (table, a, b, _) in enumerate(tables):
        x, y = F.col(a).cast("string"), F.col(b).cast("string")
        both = F.array(F.struct(x.alias("node"), y.alias("neighbour")), F.struct(y.alias("node"), x.alias("neighbour")))
        each.append(table.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select("document_id", F.inline(both), F.lit(rank).alias("rank")))
    every = reduce(DataFrame.unionByName, each).where("node <> neighbour")
    # The least number and not the text by it: a text in the buffer makes Spark sort all rows, in memory, instead of hashing them.
    least = every.groupBy("document_id", "node", "neighbour").agg(F.min("rank").alias("rank"))
    return least.select("document_id", "node", "neighbour", F.get(F.array(*[F.lit(via) for _, _, _, via in tables]), F.col("rank")).alias("via"))


def impact(changed: DataFrame, links_: DataFrame, levels: int = 2) -> DataFrame:
    """M3, M4: ``changed(document_id, id)`` to ``(document_id, source, id, distance, via)`` within ``levels`` links."""
    seen = changed.select("document_id", F.col("id").alias("source"), "id", F.lit(0).alias("distance"), F.lit(None).cast("string").alias("via"))
    frontier = seen
    for distance in range(1, levels + 1):
        step = frontier.select("document_id", "source", F.col("id").alias("node")).join(links_, ["document_id", "node"])
        near = step.groupBy("document_id", "source", F.col("neighbour").alias("id")).agg(F.min_by("via", "node").alias("via"))
        frontier = near.join(seen.select("document_id", "source", "id"), ["document_id", "source", "id"], "left_anti").select("document_id", "source", "id", F.lit(distance).alias("distance"), "via")
        seen = seen.unionByName(frontier)
    return seen


def impact_totals(reached: DataFrame) -> DataFrame:
    """M5: entities reached by each distance, the changes themselves left out."""
    return reached.where("distance > 0").groupBy("document_id", "distance").agg(F.countDistinct("id").alias("reached"), F.countDistinct("source").alias("changes"))


def describe(change: Column, scope: Column, label: Column) -> Column:
    """A change in words."""
    return F.concat_ws(" ", F.initcap(scope), F.concat(F.lit("“"), label, F.lit("”")), F.concat(F.lit("was "), change))


def terms(text: Column) -> Column:
    return question_terms(text)
