"""I-Match document fingerprints (Chowdhury et al., 2002; several lexicons after Kolcz et al., 2004).

DataFrame functions only. Document frequencies of all terms give a lexicon: the terms within a band
of inverse document frequency. It holds the hashes of these terms, no others, in a fixed number of
buckets; the band bounds their number whatever the corpus. Of a text's distinct lexicon terms, sorted, several randomised subsets
are hashed, one hash for each sub-lexicon; two texts are alike as far as these hashes agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, materialize

#: Band of the share of documents that have a term: at least 2 documents, and at most this share.
LEAST_DOCS, LEAST_SHARE, MOST_SHARE = 2, 0.001, 0.1
#: Buckets of the lexicon, so that a look-up reads a few terms. At most (mean distinct terms) / LEAST_SHARE
#: terms are in the band: 100,000 where texts have 100 distinct terms, 800 KB, of a corpus of any size.
BUCKETS = 1 << 16
#: Sub-lexicons: of each level one residue in MODULI[level] of a keyed hash, for SUBSETS residues.
MODULI, SUBSETS = (16, 64, 256, 1024), 16
#: Non-empty sub-lexicons that a level needs to count, besides the first.
LEAST_FILLED = 4
NO_ID = -(2**63)


def term_hashes(text: Column) -> Column:
    """Distinct terms of a text, as hashes: lower-cased runs of letters and digits."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, most_share: float = MOST_SHARE, buckets: int = BUCKETS) -> DataFrame:
    """One row with ``lexicon``: the hashes of the band's terms, as one array for each bucket."""
    total = F.lit(docs.count())
    seen = docs.select(F.explode(term_hashes(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    band = seen.where((F.col("df") >= F.greatest(F.lit(least_docs), total * least_share)) & (F.col("df") <= F.greatest(F.lit(float(least_docs)), total * most_share)))
    filled = band.groupBy(F.pmod("term", F.lit(buckets)).cast("int").alias("at")).agg(F.sort_array(F.collect_list("term")).alias("terms"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("at")).join(filled, "at", "left")
    return every.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", F.coalesce("terms", F.array().cast("array<bigint>")).alias("terms")))), lambda s: s["terms"]).alias("lexicon"))


def lexicon_terms(terms: Column, lexicon: Column, buckets: int = BUCKETS) -> Column:
    """The terms that are in the lexicon, sorted; all terms of a text that has none of it."""
    inside = F.filter(terms, lambda t: F.array_contains(F.element_at(lexicon, (F.pmod(t, F.lit(buckets)) + 1).cast("int")), t))
    chosen = F.transform(F.array(inside), lambda found: F.when(F.size(found) > 0, found).otherwise(terms))
    return F.sort_array(F.element_at(chosen, 1))


def _level(ordered: Column, level: int) -> Column:
    modulus = MODULI[level]
    residue = lambda t: F.pmod(F.xxhash64(F.lit(level), t), F.lit(modulus))
    some = F.transform(F.filter(ordered, lambda t: residue(t) < SUBSETS), lambda t: F.struct(t.alias("t"), residue(t).alias("r")))
    step = lambda r: lambda acc, s: F.when(s["r"] == r, F.hash(acc, s["t"])).otherwise(acc)
    short = lambda h: (h.bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short")
    each = lambda terms: F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), lambda r: short(F.aggregate(terms, F.lit(None).cast("int"), step(r))))
    # An array of one, so that the terms are picked once and not for each sub-lexicon.
    return F.element_at(F.transform(F.array(some), each), 1)


def subset_hashes(ordered: Column) -> Column:
    """An array of 16-bit hashes of the sorted terms of each sub-lexicon; null for an empty one."""
    return F.concat(*(_level(ordered, k) for k in range(len(MODULI))))


def as_text(hashes: Column) -> Column:
    """A fingerprint as hexadecimal numbers with ``-`` for an empty sub-lexicon."""
    return F.array_join(F.transform(hashes, lambda h: F.coalesce(F.lower(F.hex(h.cast("int") + 0x8000)), F.lit("-"))), ",")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: of the level that shows most agreement, the share of equal hashes among the filled sub-lexicons.

    Finer levels count only where they have enough filled sub-lexicons. Two empty texts are alike.
    """
    both = F.arrays_zip(a.alias("x"), b.alias("y"))
    levels = []
    for k in range(len(MODULI)):
        part = F.slice(both, k * SUBSETS + 1, SUBSETS)
        filled = F.size(F.filter(part, lambda s: s["x"].isNotNull() | s["y"].isNotNull()))
        equal = F.size(F.filter(part, lambda s: s["x"] == s["y"]))
        levels.append(F.when(filled >= (LEAST_FILLED if k else 1), equal / filled))
    return F.coalesce(F.greatest(*levels), F.lit(1.0))


def following(keys: DataFrame) -> DataFrame:
    """``keys(id, th, ...)`` with ``next_id, next_th``, the next row by (id, th); after the last, the first.

    Rows are dealt by range, so each range finds its followers alone; only the first key of each
    range, one row a partition, is looked at together.
    """
    ranged = materialize(keys.repartitionByRange("id", "th").withColumn("part", F.spark_partition_id()), "ranges")
    inner = Window.partitionBy("part").orderBy("id", "th")
    led = ranged.withColumn("next", F.lead(F.struct("id", "th")).over(inner))
    firsts = ranged.groupBy("part").agg(F.min(F.struct("id", "th")).alias("first"))
    order = Window.orderBy("part")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = firsts.withColumn("after", F.coalesce(F.lead("first").over(order), F.min("first").over(whole))).select("part", "after")
    return led.join(after, "part").withColumn("next", F.coalesce("next", "after")).select(*keys.columns, F.col("next.id").alias("next_id"), F.col("next.th").alias("next_th"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` to ``(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)``.

    The edited text has the last floor(n_chars / 4) characters replaced by as many of the start of
    the next document's text, by ascending doc_id, or by all of it if shorter. A null text is an
    empty one; a null id comes first. Rows with one id are in the order of their text's hash, and
    rows that repeat in id and text are one document whose result repeats. One document alone is
    its own next. Equal texts have equal fingerprints; a text without terms has an empty one,
    which is like another empty one only.
    """
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    keyed = base.withColumn("th", F.xxhash64("text"))
    # Both uses of the texts below are one plan, so that Spark shuffles them once.
    unique = keyed.dropDuplicates(["id", "th"])
    order = materialize(following(keyed.groupBy("id", "th").agg(F.first(F.length("text")).alias("n"), F.count("*").alias("copies"))), "order")
    words = materialize(lexicon(base.select("text")), "lexicon")
    wanted = order.select(F.col("next_id").alias("id"), F.col("next_th").alias("th"), F.col("id").alias("to_id"), F.col("th").alias("to_th"), "copies", F.floor(F.col("n") / 4).cast("int").alias("need"))
    heads = unique.join(wanted, ["id", "th"]).select(F.col("to_id").alias("id"), F.col("to_th").alias("th"), F.col("id").alias("next_id"), F.col("th").alias("next_th"), "copies", "need", F.expr("substring(text, 1, need)").alias("head"))
    both = unique.join(heads, ["id", "th"]).withColumn("n_chars", F.length("text").cast("long"))
    both = both.withColumn("edited", F.concat(F.expr("substring(text, 1, cast(n_chars as int) - need)"), "head"))
    keep = ["id", "th", "next_id", "next_th", "copies", "n_chars"]
    picked = both.select(*keep, "edited", term_hashes(F.col("text")).alias("f"), term_hashes(F.col("edited")).alias("e"))
    # The lexicon is one value of bounded size, so it can stand beside every row.
    picked = picked.withColumn("lexicon", words.scalar()).select(*keep, F.unhex(F.sha2("edited", 256)).alias("sha"), *(lexicon_terms(F.col(c), F.col("lexicon")).alias(c) for c in "fe"))
    made = materialize(picked.select(*keep, "sha", *(subset_hashes(F.col(c)).alias(c) for c in "fe")), "fingerprints")
    discard(order, words)
    after = made.select(F.col("id").alias("next_id"), F.col("th").alias("next_th"), F.col("f").alias("g"))
    out = made.join(after, ["next_id", "next_th"]).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return out.select(
        F.nullif("id", F.lit(NO_ID)).alias("doc_id"), "n_chars", F.lower(F.hex("sha")).alias("edited_sha256"), as_text(F.col("f")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("f"), F.col("e")).alias("near_edited"), likeness(F.col("f"), F.col("g")).alias("near_next"),
    )
