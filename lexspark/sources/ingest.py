"""Files to documents, pages and text matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import collapse, cut, sanitize, stable_hash
from ..operators.sweeps import last_before

MOST_BYTES, MOST_PAGES, MOST_CHARS = 25 * 1024 * 1024, 400, 2_000_000
# File types by MIME type and by extension.
MIME = {"application/pdf": "pdf", "text/plain": "txt", "text/markdown": "md", "text/x-markdown": "md"}
EXTENSIONS = {"pdf": "pdf", "txt": "txt", "text": "txt", "md": "md", "markdown": "md"}


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def file_type(name: Column, mime: Column) -> Column:
    """By MIME type, then by extension; null if neither is known."""
    out = F.when(F.lit(False), F.lit(""))
    for k, v in MIME.items():
        out = out.when(F.lower(mime) == k, v)
    for k, v in EXTENSIONS.items():
        out = out.when(extension(name) == k, v)
    return out


def upload_code(name: Column, mime: Column, n_bytes: Column, most: int = MOST_BYTES) -> Column:
    """The first rule that a file breaks; null if it may be read."""
    return (
        F.when(name.isNull() | (name == ""), "upload.no-file")
        .when(file_type(name, mime).isNull(), "upload.unsupported-type")
        .when(n_bytes <= 0, "upload.empty")
        .when(n_bytes > most, "upload.too-large")
    )


def describe(files: DataFrame) -> DataFrame:
    """S3: what a file is, in words."""
    kb = F.round(F.col("n_bytes") / 1024, 1)
    return files.withColumn("extension", extension(F.col("name"))).withColumn("size_label", F.concat(kb.cast("string"), F.lit(" KB")))


def content_code(file_type_: Column, text: Column, most: int = MOST_CHARS) -> Column:
    """Why a parsed text cannot be used; null if it can."""
    return F.when(text.isNull() | (F.trim(text) == ""), F.when(file_type_ == "pdf", "content.no-text-layer").otherwise("content.no-text")).when(F.length(text) > most, "content.too-long")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files as ``(name, n_bytes, raw)``; whole files, one row each."""
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.{txt,text,md,markdown}").load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("n_bytes"), F.decode("content", F.lit("UTF-8")).alias("raw"))


def read_pdfs(spark: SparkSession, path: str, extract) -> DataFrame:
    """PDF files by ``extract(bytes) -> list of page texts``; a page or file that fails gives a warning and no text."""
    from collections.abc import Iterator

    import pandas as pd

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("n_bytes"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for data in batch["content"]:
                try:
                    rows.append(("\f".join(extract(data)[:MOST_PAGES])[:MOST_CHARS], None))
                except Exception as e:  # the extractor is foreign code
                    rows.append((None, f"unreadable: {e}"[:200]))
            yield batch[["name", "n_bytes"]].assign(raw=[r[0] for r in rows], warning=[r[1] for r in rows])

    return raw.mapInPandas(run, "name string, n_bytes long, raw string, warning string")


def document_id(name: Column, n_bytes: Column) -> Column:
    """From file name and size."""
    return F.concat(F.lit("doc_"), stable_hash(F.concat_ws(":", name, n_bytes.cast("string"))))


def fingerprint(document_id_: Column, text: Column) -> Column:
    """From id, length and the first 512 characters."""
    return stable_hash(F.concat_ws("|", document_id_.cast("string"), F.length(text).cast("string"), F.substring(text, 1, 512)))


def pages(content: DataFrame, separator: str = "\f") -> DataFrame:
    """``content(document_id, raw)`` to ``(document_id, page_number, text, char_start, char_end)``; pages are joined by two line feeds."""
    split = content.select("document_id", F.posexplode(F.split("raw", separator)).alias("pos", "raw_page")).withColumn("text", sanitize(F.col("raw_page")))
    before = Window.partitionBy("document_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("text") + 2).over(before), F.lit(0)).cast("int")
    return split.select("document_id", (F.col("pos") + 1).alias("page_number"), "text", start.alias("char_start"), (start + F.length("text")).alias("char_end"))


def joined(page_table: DataFrame) -> DataFrame:
    """Pages back to ``(document_id, text, page_count, char_count)``."""
    out = page_table.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda p: p["text"]), "\n\n").alias("text"), F.count("*").cast("int").alias("page_count"))
    return out.withColumn("char_count", F.length("text"))


def page_at(points: DataFrame, page_table: DataFrame) -> DataFrame:
    """The last page that starts at or before each offset, else the first: an as-of join by document."""
    p = page_table.select("document_id", F.col("page_number").alias("page"), "char_start")
    return points.join(last_before(points, p, "char_start", ["page"]), ["document_id", "offset"], "left").withColumn("page", F.coalesce("page", F.lit(1)))


def snippet(text: Column, start: Column, end: Column, most: int = 400) -> Column:
    """A range on one line, cut."""
    return cut(collapse(F.substring(text, start + 1, end - start)), most)


def find_text(content: DataFrame, needle: str, ignore_case: bool = True, most: int = 50) -> DataFrame:
    """``(document_id, place, offset)`` of the occurrences that do not overlap, at most ``most`` a document.

    The gaps between occurrences are the parts of a split, so offsets are sums of their lengths.
    """
    if not needle:
        return content.select("document_id", F.lit(0).alias("place"), F.lit(0).alias("offset")).limit(0)
    text = F.lower("text") if ignore_case else F.col("text")
    literal = "\\Q" + (needle.lower() if ignore_case else needle).replace("\\E", "\\E\\\\E\\Q") + "\\E"
    lengths = F.transform(F.split(F.coalesce(text, F.lit("")), literal, -1), lambda s: F.length(s))
    n = len(needle)
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    folded = F.aggregate(F.slice(lengths, F.lit(1), F.size(lengths) - 1), zero, lambda acc, g: F.struct((acc["at"] + g + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + g)).alias("out")))
    return content.select("document_id", F.posexplode(F.slice(folded["out"], 1, most)).alias("place", "offset"))


def search_clauses(clauses: DataFrame, needle: str, most: int = 4) -> DataFrame:
    """The first clauses of each document that hold a text."""
    hit = clauses.where(F.contains(F.lower(F.concat_ws(" ", "number", "heading", "text")), F.lit(needle.lower())))
    return hit.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("ord"))).where(F.col("place") <= most)
