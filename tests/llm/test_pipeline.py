"""The corpus pipeline stage by stage."""

from pyspark.sql import functions as F

import corpus_pipeline
from lexspark.llm import mixing, pii, superminhash


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = corpus_pipeline.keep_languages(spark, docs, sf)
    assert kept.columns == docs.columns and kept.count() >= 0.9 * docs.count()
    once = corpus_pipeline.drop_near_duplicates(spark, kept, sf)
    assert once.columns == docs.columns and 0 < once.count() < kept.count()
    assert superminhash.near_duplicates(once).where("not kept").count() == 0
    clean = corpus_pipeline.redact_personal_data(spark, once, sf)
    assert clean.columns == docs.columns and pii.scan(clean).where("spans <> ''").count() == 0
    mixed = corpus_pipeline.mix_sources(spark, clean, sf)
    plan = mixing.mix(clean)
    assert mixed.columns == docs.columns and mixed.count() == plan.where("size > 0").selectExpr("sum(taken div size) n").first()["n"]
    assert corpus_pipeline.encode_pieces(spark, mixed, sf).where("not lossless").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and set(out.columns) == {"doc_id", "n_pieces", "pieces_sha256", "lossless", "pieces"}


def test_near_dedup_keeps_what_shares_an_id(spark):
    """A unique text whose id a copy has too stays; copies without id go, but for one where none has an id."""
    a, b, c = ("one two three four five six seven eight nine " * 3, "ten eleven twelve thirteen fourteen fifteen " * 3, "lone text of its own with more than five words in it")
    rows = [(1, a, 9), (4, a, 9), (4, c, 9), (None, a, 9), (None, b, 9), (None, b, 9), (7, None, 9), (7, None, 9), (8, "", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node int").withColumn("class", F.lit(1)).withColumn("members", F.lit("m"))
    got = superminhash.survivors(docs)
    assert got.columns == docs.columns
    assert sorted(((r["doc_id"] or 0, r["text"] or "") for r in got.collect())) == sorted([(1, a), (4, c), (0, b), (7, ""), (8, "")])


def test_stages_on_odd_rows(spark):
    """Nulls in any column, repeated rows, a very long text, an empty table, clashing column names: no stage fails or loses columns."""
    kinds = "doc_id long, text string, lang string, source string, n_chars long, size string, node int"
    rows = [(1, None, "en", "a", 0, "s", 1), (2, "", None, None, 0, None, None), (3, "word another " * 40_000, "en", "a", 1, "s", 1), (4, "Ein Satz mit Worten.", None, None, None, "s", 1), (4, "Ein Satz mit Worten.", None, None, None, "s", 1), (None, "no id here at all, mail a@b.org", "en", "b", 1, "s", 1)]
    for table in (spark.createDataFrame(rows, kinds), spark.createDataFrame([], kinds)):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            assert name == "pieces" or out.columns == docs.columns
            assert out.count() <= 3 * max(1, docs.count())
            docs = out
