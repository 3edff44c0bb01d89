"""Clause segmentation, typing, references, trees, chunks and offset lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import ascii_edges, collapse, cut, matches
from .sweeps import innermost, last_before, overlaps

# Heading shapes as (pattern, group of the number, group of the heading, level, longest line).
HEADINGS = [
    (r"^(\d+(?:\.\d+)+)\.?\s+(\S.*)$", None, 600),
    (r"^(\d+)\.\s+(\S.*)$", 1, 600),
    (r"(?i)^(?:article|art\.)\s+([0-9IVXLC]+)\b[\s.:-]*(.*)$", 1, 600),
    (r"(?i)^(?:section|§)\s*([0-9]+(?:\.[0-9]+)*)\b[\s.:-]*(.*)$", 1, 600),
    (r"(?i)^(?:clause)\s+([0-9]+(?:\.[0-9]+)*)\b[\s.:-]*(.*)$", 1, 600),
    (r"^\(([a-z])\)\s+(\S.*)$", 3, 300),
    (r"(?i)^\(([ivxl]+)\)\s+(\S.*)$", 4, 300),
    (r"(?i)^((?:schedule|annex|exhibit|appendix)\s+[0-9A-Z]+)\b[\s.:-]*(.*)$", 1, 600),
]

# Clause types by heading, then by heading and text; the first that matches counts.
HEADING_TYPES = [
    ("schedule", [r"^(schedule|annex|exhibit|appendix)\b"]),
    ("definitions", [r"^definitions?\b", r"\bdefined terms\b"]),
    ("payment", [r"^(payment|fees|invoicing|charges)\b"]),
    ("termination", [r"^(termination|expiry|expiration)\b"]),
    ("renewal", [r"^renewal\b"]),
    ("term", [r"^(term|duration)\b"]),
    ("confidentiality", [r"^(confidentiality|confidential information)\b"]),
    ("liability", [r"^liabilit(y|ies)\b"]),
]
TEXT_TYPES = [
    ("definitions", [r"\bdefinitions? and interpretation\b"]),
    ("survival", [r"\bshall survive\b", r"\bsurvive (the )?(termination|expiry|expiration)\b"]),
    ("confidentiality", [r"\bconfidential information\b", r"\bconfidentiality\b", r"\bnon[- ]disclosure\b", r"\breceiving party\b"]),
    ("indemnity", [r"\bindemnif(y|ies|ication)\b", r"\bhold harmless\b"]),
    ("liability", [r"\bliabilit(y|ies)\b", r"\blimitation of liability\b", r"\bshall not be limited or excluded\b"]),
    ("suspension", [r"\bsuspend(ed|ing|sion)?\b"]),
    ("subcontracting", [r"\bsubcontract(ed|ing|or|s)?\b"]),
    ("assignment", [r"\bassign(ed|ment|s)?\b", r"\bchange of control\b", r"\btransfer of this agreement\b"]),
    ("remedies", [r"\bremedies\b", r"\bspecific performance\b", r"\binjunct(ion|ive)\b"]),
    ("termination", [r"\bterminat(e|ed|es|ing|ion)\b", r"\bmaterial breach\b", r"\bnot cured within\b"]),
    ("renewal", [r"\bautomatic(ally)? renew", r"\brenew(al|s|ed)?\b", r"\bsuccessive periods?\b", r"\bextension of the term\b"]),
    ("term", [r"\binitial term\b", r"\bterm of (this|the) agreement\b", r"\bcommences on\b", r"\bcontinues until\b", r"\bduration of (this|the) agreement\b"]),
    ("payment", [r"\bpay(ment|ments|able|s)?\b", r"\binvoice(s|d)?\b", r"\bfees?\b", r"\binterest at\b", r"\baccrue interest\b", r"\bremuneration\b"]),
    ("services", [r"\bshall provide the services\b", r"\bservices\b", r"\bdeliverables?\b", r"\bservice levels?\b", r"\bstatement of work\b"]),
    ("reporting", [r"\breport(ing|s)?\b", r"\bcompliance report\b"]),
    ("governing-law", [r"\bgoverning law\b", r"\bgoverned by the laws\b", r"\bjurisdiction of\b"]),
    ("dispute-resolution", [r"\bdispute\b", r"\barbitration\b", r"\bmediation\b"]),
    ("force-majeure", [r"\bforce majeure\b", r"\bbeyond its reasonable control\b"]),
    ("notice", [r"\bwritten notice\b", r"\bnotices\b", r"\bnotice period\b"]),
]
#: A definition is told by its capital letter, so this one minds case.
DEFINES = r'(^|\n)\s*"?[A-Z][^"\n]{0,80}"?\s+(means|shall mean|refers to)\b'


def heading(line: Column) -> Column:
    """``struct<number, heading, level>`` of a line that is a heading; null if it is none."""
    line = F.trim(collapse(line))
    out = F.when(F.lit(False), F.lit(None).cast("struct<number:string,heading:string,level:int>"))
    for pattern, level, longest in HEADINGS:
        p = ascii_edges(pattern)
        number = F.regexp_extract(line, p, 1)
        found = F.struct(
            number.alias("number"),
            F.nullif(cut(F.trim(F.regexp_extract(line, p, 2)), 160), F.lit("")).alias("heading"),
            (F.lit(level) if level else F.size(F.split(number, r"\."))).cast("int").alias("level"),
        )
        out = out.when(line.rlike(p) & (F.length(line) <= longest), found)
    capitals = (F.length(line) <= 80) & line.rlike(r"[A-Z]") & line.rlike(r"^[A-Z0-9 ,.'&()/-]+$") & (F.size(F.split(line, r"\s+")) <= 8)
    return out.when(capitals, F.struct(F.lit(None).cast("string").alias("number"), line.alias("heading"), F.lit(1).alias("level")))


def clause_type(heading_: Column, number: Column, text: Column) -> Column:
    """The first rule by heading, or number without one, then by heading and text; else ``other``."""
    head = F.coalesce(heading_, number, F.lit(""))
    whole = F.concat_ws("\n", heading_, text)
    out = reduce(lambda acc, r: acc.when(matches(head, r[1]), r[0]), HEADING_TYPES, F.when(F.lit(False), F.lit("")))
    out = out.when(matches(whole, [DEFINES], ignore_case=False), "definitions")
    return reduce(lambda acc, r: acc.when(matches(whole, r[1]), r[0]), TEXT_TYPES, out).otherwise("other")


def classify(clauses: DataFrame) -> DataFrame:
    return clauses.withColumn("clause_type", clause_type(F.col("heading"), F.col("number"), F.col("text")))


def is_weak(clause_type_: Column) -> Column:
    """Types that a later hint may replace."""
    return clause_type_.isNull() | clause_type_.isin("other", "unknown")


def lines(content: DataFrame) -> DataFrame:
    """``content(document_id, text)`` to ``(document_id, line_no, line, start_offset, end_offset)``; offsets by one running sum."""
    split = content.select("document_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    before = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("int")
    return split.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.length("line"))


def segment(content: DataFrame, most: int = 4000) -> DataFrame:
    """Sections under their headings, with offsets; text before the first heading is the Preamble, level 0.

    Returns ``(document_id, ord, number, heading, level, start_offset, end_offset, text)``; empty sections are left out.
    """
    marked = lines(content).withColumn("h", heading(F.col("line")))
    so_far = Window.partitionBy("document_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marked = marked.withColumn("section", F.least(F.sum(F.col("h").isNotNull().cast("int")).over(so_far), F.lit(most)))
    found = marked.groupBy("document_id", "section").agg(
        F.first("h", ignorenulls=True).alias("h"), F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda s: s["line"]), "\n").alias("raw"),
    )
    found = found.withColumn("text", F.trim(F.regexp_replace("raw", r"^\s+|\s+$", ""))).where("text <> ''")
    ordinal = F.row_number().over(Window.partitionBy("document_id").orderBy("section"))
    name = F.when(F.col("section") == 0, "Preamble").otherwise(F.col("h.heading"))
    return found.select("document_id", ordinal.alias("ord"), F.col("h.number").alias("number"), name.alias("heading"), F.coalesce("h.level", F.lit(0)).alias("level"), "start_offset", "end_offset", "text")


def coverage(content: DataFrame, sections: DataFrame) -> DataFrame:
    """C4: the share of a document's characters that its sections hold."""
    held = sections.groupBy("document_id").agg(F.sum(F.length("text")).alias("held"))
    out = content.select("document_id", F.length("text").alias("whole")).join(held, "document_id", "left")
    return out.select("document_id", F.when(F.col("whole") > 0, F.round(F.coalesce("held", F.lit(0)) / F.col("whole"), 4)).otherwise(0.0).alias("coverage"))


def parents(clauses: DataFrame) -> DataFrame:
    """The clause just before is the parent if its level is lower."""
    w = Window.partitionBy("document_id").orderBy("ord")
    before = F.lag("level").over(w) < F.col("level")
    return clauses.withColumn("parent_clause_id", F.when(before, F.lag("clause_id").over(w)))


def section_paths(clauses: DataFrame) -> DataFrame:
    """Numbers of the open sections above and of the clause itself: a stack of rising levels.

    The clause's path holds, for each lower level, the last clause before it that no clause of an
    equal or lower level has closed: a fold over the document's ordered levels.
    """
    item = F.struct("ord", "level", F.coalesce("number", "heading").alias("label"), "clause_id")
    folded = clauses.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    start = F.struct(F.slice("all", 1, 0).alias("stack"), F.array().cast("array<struct<clause_id:string,path:array<string>>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        stack = F.concat(F.filter(acc["stack"], lambda e: e["level"] < s["level"]), F.array(s))
        return F.struct(stack.alias("stack"), F.concat(acc["out"], F.array(F.struct(s["clause_id"].alias("clause_id"), F.transform(stack, lambda e: e["label"]).alias("path")))).alias("out"))

    return folded.select("document_id", F.explode(F.aggregate("all", start, step)["out"]).alias("o")).select("document_id", "o.clause_id", F.col("o.path").alias("section_path"))


def tree(clauses: DataFrame, most_levels: int = 8) -> DataFrame:
    """Depth and depth-first place of each clause: its ancestors' ordinals, level by level, are the sort key."""
    at = clauses.select("document_id", "clause_id", "ord", F.col("parent_clause_id").alias("up"), F.array("ord").alias("path"))
    above = clauses.select("document_id", F.col("clause_id").alias("up"), F.col("ord").alias("up_ord"), F.col("parent_clause_id").alias("up2"))
    for _ in range(most_levels):
        at = at.join(above, ["document_id", "up"], "left").select("document_id", "clause_id", "ord", F.col("up2").alias("up"), F.when(F.col("up_ord").isNotNull(), F.concat(F.array("up_ord"), "path")).otherwise(F.col("path")).alias("path"))
    place = F.row_number().over(Window.partitionBy("document_id").orderBy("path"))
    return at.select("document_id", "clause_id", (F.size("path") - 1).alias("depth"), place.alias("place"))


REFERENCE = r"(?i)(?:clause|section|§)\s*(\d+(?:\.\d+)*)"


def mentioned_numbers(clauses: DataFrame, pattern: str = REFERENCE) -> DataFrame:
    """``(document_id, clause_id, at, number)`` for every clause number that a text mentions, in order."""
    found = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1))
    return clauses.select("document_id", "clause_id", F.posexplode(found).alias("at", "number"))


def cross_references(clauses: DataFrame) -> DataFrame:
    """``(document_id, clause_id, place, to_clause_id)``: mentions that resolve, each clause once, as first seen.

    Of clauses with one number the last counts; a clause does not refer to itself.
    """
    last = clauses.where("number is not null").groupBy("document_id", "number").agg(F.max_by("clause_id", "ord").alias("to_clause_id"))
    hits = mentioned_numbers(clauses).join(last, ["document_id", "number"]).where("to_clause_id <> clause_id")
    first = hits.groupBy("document_id", "clause_id", "to_clause_id").agg(F.min("at").alias("at"))
    return first.select("document_id", "clause_id", F.row_number().over(Window.partitionBy("document_id", "clause_id").orderBy("at")).alias("place"), "to_clause_id")


def paragraphs(content: DataFrame) -> DataFrame:
    """Runs of lines that are not blank: ``(document_id, paragraph, start_offset, end_offset)``, paragraphs from 0."""
    w = Window.partitionBy("document_id").orderBy("line_no")
    full = F.col("line").rlike(r"\S")
    fresh = full & ~F.coalesce(F.lag(full).over(w), F.lit(False))
    numbered = lines(content).withColumn("paragraph", F.sum(fresh.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return numbered.where(full).groupBy("document_id", "paragraph").agg(F.min("start_offset").alias("start_offset"), F.max("end_offset").alias("end_offset"))


def innermost_clause(points: DataFrame, clauses: DataFrame) -> DataFrame:
    """``points(document_id, offset)`` with the smallest clause around each, the first of equals; by a sweep over each document."""
    rank = F.struct((F.col("end_offset") - F.col("start_offset")).alias("size"), "ord")
    return points.join(innermost(points, clauses, "clause_id", rank), ["document_id", "offset"], "left")


def clauses_in_range(ranges: DataFrame, clauses: DataFrame) -> DataFrame:
    """Clauses that overlap ``ranges(document_id, range_id, from_offset, to_offset)``, both ends included; by a sweep over each document."""
    asked = ranges.select("document_id", "range_id", F.col("from_offset").alias("lo"), F.col("to_offset").alias("hi"))
    return overlaps(asked, clauses.select("document_id", "clause_id", F.col("start_offset").alias("lo"), F.col("end_offset").alias("hi")), "range_id", "clause_id")


def pack_chunks(clauses: DataFrame, most: int = 48_000) -> DataFrame:
    """Clauses packed in order into chunks of at most ``most`` characters; a longer clause is a cut chunk of its own.

    A fold over each document's clauses, which holds offsets and ids only: a clause joins the last
    chunk if it fits and opens one if not.
    """
    item = F.struct("ord", "clause_id", "start_offset", "end_offset")
    ordered = clauses.groupBy("document_id").agg(F.array_sort(F.collect_list(item)).alias("all"))
    kind = "array<struct<start_offset:int,end_offset:int,clause_ids:array<string>,truncated:boolean>>"

    def step(done: Column, c: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        long = c["end_offset"] - c["start_offset"] > most
        fits = (F.size(done) > 0) & ~long & ~F.coalesce(last["truncated"], F.lit(True)) & (c["end_offset"] - last["start_offset"] <= most)
        grown = F.struct(last["start_offset"].alias("start_offset"), c["end_offset"].alias("end_offset"), F.concat(last["clause_ids"], F.array(c["clause_id"])).alias("clause_ids"), F.lit(False).alias("truncated"))
        fresh = F.struct(c["start_offset"].alias("start_offset"), F.when(long, c["start_offset"] + most).otherwise(c["end_offset"]).alias("end_offset"), F.array(c["clause_id"]).alias("clause_ids"), long.alias("truncated"))
        return F.when(fits, F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(done, F.array(fresh))).cast(kind)

    packed = ordered.select("document_id", F.posexplode(F.aggregate("all", F.array().cast(kind), step)).alias("chunk", "c"))
    return packed.select("document_id", "chunk", "c.*", F.ceil((F.col("c.end_offset") - F.col("c.start_offset")) / 4).cast("int").alias("tokens"))


def overlap_chunks(chunks: DataFrame, carried: int = 1) -> DataFrame:
    """C11: each chunk with the last ``carried`` clauses of the one before it."""
    before = F.lag("clause_ids").over(Window.partitionBy("document_id").orderBy("chunk"))
    n = F.least(F.size(before), F.lit(carried))
    return chunks.withColumn("carried_ids", F.when(before.isNotNull(), F.slice(before, F.size(before) - n + 1, n)).otherwise(F.array().cast("array<string>")))


def chunk_clauses(chunks: DataFrame, clauses: DataFrame) -> DataFrame:
    """C17: clauses of each chunk by overlap, and those carried from outside it."""
    ranges = chunks.select("document_id", F.col("chunk").alias("range_id"), F.col("start_offset").alias("from_offset"), F.col("end_offset").alias("to_offset"))
    inside = clauses_in_range(ranges, clauses).withColumn("carried", F.lit(False))
    if "carried_ids" not in chunks.columns:
        return inside
    carried = chunks.select("document_id", F.col("chunk").alias("range_id"), F.explode("carried_ids").alias("clause_id"))
    return inside.unionByName(carried.join(inside, ["document_id", "range_id", "clause_id"], "left_anti").withColumn("carried", F.lit(True)))


def summarize_chunks(chunks: DataFrame) -> DataFrame:
    """Chunks, tokens and cut chunks of each document."""
    return chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.sum("tokens").alias("tokens"), F.count_if("truncated").alias("truncated"))


def with_offsets(clauses: DataFrame, gap: int = 1) -> DataFrame:
    """Offsets of the clauses in the text that joins them with ``gap`` characters between."""
    before = Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + gap).over(before), F.lit(0)).cast("int")
    return clauses.withColumn("start_offset", start).withColumn("end_offset", F.col("start_offset") + F.length("text"))


def locate(points: DataFrame, clauses: DataFrame, paragraph_table: DataFrame, pages: DataFrame) -> DataFrame:
    """Page, paragraph and innermost clause of ``points(document_id, offset)``.

    Paragraphs and pages are in order and apart, so that the last one to start tells; a point after
    the end of its paragraph has none.
    """
    p = paragraph_table.select("document_id", "paragraph", F.col("start_offset").alias("p0"), F.col("end_offset").alias("p1"))
    inside = last_before(points, p, "p0", ["paragraph", "p1"]).where("offset <= p1").drop("p1")
    page = last_before(points, pages.select("document_id", "page_number", "char_start"), "char_start", ["page_number"]).withColumnRenamed("page_number", "page")
    return innermost_clause(points, clauses).join(inside, ["document_id", "offset"], "left").join(page, ["document_id", "offset"], "left")
