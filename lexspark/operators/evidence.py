"""Evidence: quotes checked against documents."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import SPACES, comparable, stable_hash
from ..shipping import ship
from .sweeps import by_document

# What the comparison form leaves out, takes for white space, and writes straight.
_GONE = re.compile(r"[\u0000-\u0008\u000B\u000E-\u001F\u007F-\u009F\u200B-\u200F\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFEFF]")
_SPACE = re.compile(SPACES)
_WORD = re.compile(r"\S+")
_STRAIGHT = str.maketrans("‘’“”", "''\"\"")

#: Entity types that do not stand without a verified quote.
REQUIRED = ["obligation", "right", "condition", "deadline", "consequence", "definition"]


def normalize(evidence: DataFrame, most: int = 600) -> DataFrame:
    """V1: quotes cut without an ellipsis, and ids that depend on the content."""
    quote = F.substring(F.trim(F.coalesce("source_text", F.lit(""))), 1, most)
    key = F.concat_ws("|", F.col("document_id").cast("string"), F.coalesce("clause_id", F.lit("")), quote, F.coalesce(F.col("start_offset").cast("string"), F.lit("")))
    return evidence.withColumn("source_text", quote).withColumn("id", F.coalesce("id", F.concat(F.lit("ev_"), stable_hash(key))))


def verify(evidence: DataFrame, content: DataFrame, clauses: DataFrame) -> DataFrame:
    """The first reason that applies as ``status``, and ``verified``.

    ``content(document_id, text, page_count)``. A quote is checked at its range if it has one,
    else in the whole text; both in the comparison form.
    """
    known = clauses.select("document_id", "clause_id", F.lit(True).alias("known")).distinct()
    # A document's text is put in its comparison form once, and not for each quote.
    doc = content.select("document_id", F.col("text").alias("doc_text"), comparable(F.col("text")).alias("doc_plain"), "page_count", F.lit(True).alias("has_doc"))
    # The document's text joins last, and is not dealt out again with each quote.
    x = evidence.join(known, ["document_id", "clause_id"], "left").join(doc, "document_id", "left")
    c = F.col
    needle = comparable(c("source_text"))
    ranged = c("start_offset").isNotNull() & c("end_offset").isNotNull()
    piece = comparable(F.expr("substring(doc_text, start_offset + 1, end_offset - start_offset)"))
    at_range = F.contains(piece, needle) | ((F.length(piece) > 0) & F.contains(needle, piece))
    status = (
        F.when(c("document_id").isNull(), "missing-document")
        .when(c("has_doc").isNull(), "other-document")
        .when(c("clause_id").isNotNull() & c("known").isNull(), "unknown-clause")
        .when(F.coalesce(needle, F.lit("")) == "", "missing-text")
        .when(c("page").isNotNull() & ~c("page").between(1, c("page_count")), "unknown-clause")
        .when(F.coalesce(c("doc_text"), F.lit("")) == "", "no-text")
        .when(ranged & ((c("start_offset") < 0) | (c("end_offset") <= c("start_offset")) | (c("end_offset") > F.length("doc_text"))), "invalid-range")
        .when(ranged & at_range, "verified")
        .when(F.contains(c("doc_plain"), needle), "verified")
        .otherwise("text-mismatch")
    )
    return x.withColumn("status", status).withColumn("verified", F.col("status") == "verified").drop("doc_text", "doc_plain", "page_count", "has_doc", "known")


def by_entity(verified: DataFrame) -> DataFrame:
    """V4: verified and all quotes of each entity."""
    return verified.groupBy("document_id", "entity_id", "entity_type").agg(F.count("*").alias("total"), F.count_if("verified").alias("verified"))


def rejected(entities: DataFrame, verified: DataFrame, required: list[str] = REQUIRED) -> DataFrame:
    """V4: entities ``(document_id, id, entity_type)`` of a required type without a verified quote."""
    good = verified.where("verified").select("document_id", F.col("entity_id").alias("id"))
    return entities.where(F.col("entity_type").isin(required)).join(good, ["document_id", "id"], "left_anti")


def prune(entities: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V4: what stays without the rejected entities: edges need both ends."""
    ids = gone.select("document_id", "id")
    kept = entities.join(ids, ["document_id", "id"], "left_anti")
    for end in ("from_id", "to_id"):
        edges = edges.join(ids.withColumnRenamed("id", end), ["document_id", end], "left_anti")
    return kept, edges


def coverage(facts: DataFrame, verified: DataFrame) -> DataFrame:
    """V5: facts with quotes, with verified ones, and the share, of each document."""
    n = by_entity(verified).select("document_id", F.col("entity_id").alias("id"), "total", F.col("verified").alias("good"))
    x = facts.join(n, ["document_id", "id"], "left").na.fill(0, ["total", "good"])
    out = x.groupBy("document_id").agg(F.count("*").alias("facts"), F.count_if(F.col("total") > 0).alias("with_evidence"), F.count_if(F.col("good") > 0).alias("verified"))
    return out.withColumn("ratio", F.when(F.col("facts") > 0, F.round(F.col("verified") / F.col("facts"), 4)).otherwise(0.0))


def collect_facts(tables: dict[str, DataFrame]) -> DataFrame:
    """V6: ``(document_id, id, entity_type, clause_id)`` of all fact tables."""
    each = [t.select("document_id", "id", F.lit(kind).alias("entity_type"), (F.col("clause_id") if "clause_id" in t.columns else F.lit(None).cast("string")).alias("clause_id")) for kind, t in tables.items()]
    return reduce(DataFrame.unionByName, each)


def by_clause(facts: DataFrame) -> DataFrame:
    """V7: fact ids of each clause; those without a clause under a null one."""
    return facts.groupBy("document_id", "clause_id").agg(F.array_sort(F.collect_set("id")).alias("fact_ids"))


def roll_up(facts: DataFrame, verified: DataFrame) -> DataFrame:
    """V8, V9: fact-clause pairs by clause and type, with the document's totals in a row whose clause is null.

    Grouping sets: one pass gives both levels.
    """
    n = by_entity(verified).select("document_id", F.col("entity_id").alias("id"), "total", F.col("verified").alias("good"))
    x = facts.where("clause_id is not null").join(n, ["document_id", "id"], "left").na.fill(0, ["total", "good"])
    view = x.groupingSets([["document_id", "clause_id"], ["document_id"]], "document_id", "clause_id")
    return view.agg(F.count("*").alias("pairs"), F.count_if(F.col("good") > 0).alias("verified"), F.count_if((F.col("total") > 0) & (F.col("good") == 0)).alias("unverified"), F.count_if(F.col("total") == 0).alias("missing"))


def citation(number: Column, page: Column) -> Column:
    """A place in words."""
    return F.concat_ws(" · ", F.concat(F.lit("§"), number), F.concat(F.lit("p. "), page.cast("string")))


def source_offset(evidence: DataFrame, content: DataFrame) -> DataFrame:
    """Where a quote stands: its own offset, else where its text is first found; -1 if nowhere."""
    x = evidence.join(content.select("document_id", F.col("text").alias("doc_text")), "document_id", "left")
    return x.withColumn("offset", F.coalesce("start_offset", F.expr("position(source_text in doc_text) - 1"))).drop("doc_text")


def plain(text: str) -> tuple[str, list[int]]:
    """The comparison form of a text, and for each of its characters the offset in the text."""
    return _plain_by_character(text) if not text.isascii() or _GONE.search(text) else _plain_by_word(text)


def _plain_by_word(text: str) -> tuple[str, list[int]]:
    """:func:`plain` of a text in ASCII without characters that go: each word has its own offsets, and the space before it that of the first one there."""
    words: list[str] = []
    at: list[int] = []
    end = 0
    for word in _WORD.finditer(text):
        if words:
            at.append(end)
        start, end = word.span()
        words.append(word[0])
        at += range(start, end)
    return " ".join(words).lower(), at


def _plain_by_character(text: str) -> tuple[str, list[int]]:
    out: list[str] = []
    at: list[int] = []
    gap = None
    for i, c in enumerate(text):
        if _GONE.match(c):
            continue
        if _SPACE.match(c):
            gap = i if gap is None else gap
            continue
        if gap is not None and out:
            out.append(" ")
            at.append(gap)
        gap = None
        low = c.lower().translate(_STRAIGHT)
        out += low
        at += [i] * len(low)
    return "".join(out), at


def _placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows by document, its text first: each quote to where it first stands in the text that the task holds."""
    document, text, at = None, "", []
    for batch in batches:
        rows = []
        for doc, content, key, quote in zip(batch["document_id"].tolist(), batch["content"], batch["key"], batch["quote"], strict=True):
            if content is not None:
                document = doc
                text, at = plain(content)
                continue
            needle = plain(quote)[0] if doc == document and quote else ""
            found = text.find(needle) if needle else -1
            rows.append((doc, key, at[found] if found >= 0 else -1, at[found + len(needle) - 1] + 1 if found >= 0 else -1))
        yield pd.DataFrame(rows, columns=["document_id", "key", "start_offset", "end_offset"])


def quote_places(quotes: DataFrame, content: DataFrame, key: str) -> DataFrame:
    """``quotes(document_id, key, source_text)`` to ``(document_id, key, start_offset, end_offset)`` in the source text, -1 where it does not stand.

    Quotes are found whatever their case, quotation marks, white space and invisible characters. A
    document's text is normalised once, with its offsets kept, and its quotes stream past it.
    """
    ship(quotes.sparkSession)
    kind = quotes.schema["document_id"].dataType.simpleString()
    none = F.lit(None).cast("string")
    docs = content.where("document_id is not null and text is not null").select("document_id", F.lit(0).alias("turn"), F.col("text").alias("content"), none.alias("key"), none.alias("quote"))
    asked = quotes.where("document_id is not null").select("document_id", F.lit(1).alias("turn"), none.alias("content"), F.col(key).cast("string").alias("key"), F.col("source_text").alias("quote"))
    rows = by_document(docs.unionByName(asked), "turn").drop("turn")
    found = rows.mapInPandas(_placed, f"document_id {kind}, key string, start_offset int, end_offset int")
    return found.select("document_id", F.col("key").cast(quotes.schema[key].dataType).alias(key), "start_offset", "end_offset")


def merge(evidence: DataFrame) -> DataFrame:
    """Of quotes of one entity with the same place and text the first."""
    w = Window.partitionBy("document_id", "entity_id", "clause_id", "source_text", "start_offset").orderBy("id")
    return evidence.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")
