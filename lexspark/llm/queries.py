"""The queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann_srs, extract, imatch, langid, licenses, mixing, pieces, pii, spelling, superminhash, tiles, warc, whitening


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_srs.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op2_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(_docs(spark, sf_dir), words=3, percent=85)


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_docs(spark, sf_dir))


def op4_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_docs(spark, sf_dir))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(_pages(spark, sf_dir)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents as files: a directory for each source and thousand ids, in it every hundredth id a licence file; documents without id are one file of their source."""
    name = F.when(F.col("doc_id") % 100 == 0, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.floor(F.col("doc_id") / 1000).cast("string"), F.coalesce(name, F.lit("none.txt")))
    files = _docs(spark, sf_dir).select(path.alias("path"), "text")
    doc_id = F.regexp_extract("path", r"(?:^|/)(?:LICENSE\.)?(-?[0-9]+)(?:\.txt)?$", 1).try_cast("long")
    return licenses.scan(files).select(doc_id.alias("doc_id"), "path", "licence", "score", "origin", "from_directory")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    trees = langid.train(docs.where(~langid.held_out()))
    return langid.identify(docs, trees).select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "bits_per_byte", "rejected")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_docs(spark, sf_dir))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_docs(spark, sf_dir), with_ids=False)


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract(_pages(spark, sf_dir))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.components(_docs(spark, sf_dir), words=5, percent=80)


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_superminhash": op2_superminhash,
    "op3_pii": op3_pii,
    "op4_imatch": op4_imatch,
    "op5_warc": op5_warc,
    "op6_licenses": op6_licenses,
    "op7_language": op7_language,
    "op8_mixing": op8_mixing,
    "op9_pieces": op9_pieces,
    "op10_main_text": op10_main_text,
    "op11_whitening": op11_whitening,
    "op12_tiles": op12_tiles,
    "op13_spelling": op13_spelling,
    "pipeline": pipeline,
}

_UPPER, _LOWER = spelling.UPPER, spelling.LOWER


def _sql_components(words: int, percent: int, kept: bool) -> str:
    """Components of documents linked by their shingle sets, by counting common shingles of every pair that has one."""
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < {words} THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - {words - 2}), lambda i: array_to_string(ws[i:i + {words - 1}], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
    r(doc, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT doc, b FROM r JOIN links ON a = root),
    c AS (SELECT doc, min(root) AS component_id FROM r GROUP BY doc)
    SELECT doc AS doc_id, coalesce(n, 0) AS n_shingles, component_id{", doc = component_id AS kept" if kept else ""} FROM c LEFT JOIN n ON n.doc_id = doc"""


#: A byte at a time: the remainder of each byte value, then the bytes of the text.
_CRC = (
    "crc AS MATERIALIZED (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(CAST(i AS BIGINT), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS t)"
)
_SPELLING = rf"""WITH RECURSIVE {_CRC}, runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
    low AS (SELECT doc_id, translate(run, '{_UPPER}', '{_LOWER}') AS run, count(*) AS k FROM runs WHERE length(run) >= 6 GROUP BY ALL),
    hashed AS (SELECT run, k, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(hex(encode(s))), 2), lambda i: CAST(('0x' || hex(encode(s))[i + 1:i + 2]) AS BIGINT))), lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295) AS h
      FROM (SELECT run, k, concat(doc_id, ':', run) AS s FROM low), crc),
    v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN concat(run[:h % length(run)], run[h % length(run) + 2:]) ELSE run END AS word, k FROM hashed) WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
    cut AS MATERIALIZED (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v), gone AS MATERIALIZED (SELECT word, n, i, concat(word[:i - 1], word[i + 1:]) AS rest FROM cut),
    near AS (SELECT a.word, b.word AS other, b.n FROM gone a JOIN gone b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word UNION SELECT a.word, b.word, b.n FROM gone a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM gone a JOIN v b ON a.rest = b.word),
    best AS (SELECT word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n FROM near GROUP BY word),
    f AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * v.n THEN other END AS form, CASE WHEN other_n >= 5 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)),
    up(word, stop) AS (SELECT word, word FROM f UNION SELECT up.word, f.form FROM up JOIN f ON f.word = up.stop WHERE f.form IS NOT NULL)
    SELECT f.word, form, (SELECT stop FROM up JOIN f e ON e.word = up.stop WHERE up.word = f.word AND e.form IS NULL) AS root, n, n_near, form_n FROM f"""

#: The others need trees, projections, transducers, whole archives or a search for which SQL has no words.
ORACLE_SQL: dict[str, str] = {
    "op2_superminhash": _sql_components(3, 85, True),
    "op12_tiles": _sql_components(5, 80, False),
    "op13_spelling": _SPELLING,
}
