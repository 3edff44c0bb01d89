"""What steps shuffle and recompute, on small tables: the findings of round 3."""

import uuid

from pyspark.sql import functions as F

from lexspark.llm import licenses
from lexspark.operators import ask as A
from lexspark.operators import provider_runs as P


def shuffled(spark, run):
    """Result of ``run()`` and how many rows its jobs wrote to shuffles."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    track, store = context.statusTracker(), context._jsc.sc().statusStore()
    stages = {s for job in track.getJobIdsForGroup(group) for s in track.getJobInfo(job).stageIds}
    return out, sum(store.lastStageAttempt(s).shuffleWriteRecords() for s in stages)


def test_own_questions_meet_their_document_only(spark):
    """A term is held against the tokens of its own document and not against those of all; the rows are those of the general form."""
    docs, words = 40, 40
    clauses = spark.createDataFrame([(d, f"{d}-{i}", i, f"{i}.1", None if i else "Head", " ".join(f"th{d}x{w}" for w in range(words)) + (" Alpha thx." if i == 1 else "")) for d in range(docs) for i in range(2)], "document_id long, clause_id string, ord int, number string, heading string, text string")
    asked = [("q", "th TH alpha"), ("r", "head 1.1 what"), ("s", "nothing")]
    own = spark.createDataFrame([(q, d, text) for q, text in asked for d in range(docs)] + [("lost", 999, "th"), ("null", 1, None)], "question_id string, document_id long, question string")
    order = lambda df: sorted(map(tuple, df.select("document_id", "question_id", "place", "clause_id", "score", F.array_join("matched", " ")).collect()))
    got, rows = shuffled(spark, lambda: order(A.retrieve(clauses, own)))
    assert got == order(A.retrieve(clauses, spark.createDataFrame(asked, "question_id string, question string"))) and len(got) == 4 * docs
    assert rows < 10 * docs


def test_own_questions_with_duties_and_risks(spark):
    clauses = spark.createDataFrame([(1, "a", 1, "4.2", "Payment", "The buyer shall prepay."), (1, "b", 2, "5", None, "Pay pay and repay."), (1, "c", 3, None, "Law", "Nothing here."), (2, "d", 1, "1", "x", None)], "document_id long, clause_id string, ord int, number string, heading string, text string")
    more = {"obligations": spark.createDataFrame([(1, "b", "pay"), (1, "b", "pay"), (1, "zz", "pay")], "document_id long, clause_id string, summary string"), "risks": spark.createDataFrame([(1, "a"), (1, "c")], "document_id long, clause_id string")}
    big = 2**60 + 1
    own = spark.createDataFrame([(big, 1, "Pay, 4.2 PAY?"), (None, 1, "pay"), (5, 2, "pay")], "question_id long, document_id long, question string")
    got = sorted(((r["question_id"] or 0), r["place"], r["clause_id"], r["score"], r["matched"]) for r in A.retrieve(clauses, own, **more).collect())
    assert got == [(0, 1, "b", 10, ["pay"]), (0, 2, "a", 7, ["pay"]), (big, 1, "a", 21, ["pay", "4.2", "pay"]), (big, 2, "b", 20, ["pay", "pay"])]


def test_a_run_makes_its_prompts_once(spark, tmp_path):
    """Prompts are made once a run, and not once a wave and reply."""
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            made.add(len(batch))
            yield batch

    rows = [(i, 0, f"prompt {i % 20}") for i in range(25)]
    prompts = spark.createDataFrame(rows, "document_id long, chunk int, prompt string").mapInPandas(counted, "document_id long, chunk int, prompt string")
    reply = lambda text: '{"a": 1}' if text.startswith(P.AGAIN) or not text.endswith("7") else "no"
    got = P.run(prompts, reply, f"{tmp_path}/log").collect()
    assert made.value == 25
    assert sorted((r["document_id"], r["asked"], r["json"]) for r in got) == [(i, 2 if i % 10 == 7 else 1, '{"a": 1}') for i in range(25)]


def test_licence_terms_are_not_dealt_out(spark):
    """op6: of a segment its text is dealt once, and neither its terms nor their products with the templates."""
    text = f"{licenses._MIT} {licenses._MIT_KEEP}"
    run = lambda n: shuffled(spark, lambda: licenses.own_licences(spark.createDataFrame([(f"d/f{i}", f"{text} {i}") for i in range(n)], "path string, text string")).collect())
    (_, few), (got, many) = run(100), run(300)
    assert len(got) == 300 and {r["licence"] for r in got} == {"MIT"}
    # The templates' own terms are dealt out too, as often whatever the files.
    assert many - few < 10 * 200
