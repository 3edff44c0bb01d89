"""Runs of a provider that can be taken up again.

Every prompt has a key, the hash of its text and the settings. Replies go to a log, in waves of about
equal size, each appended by one job; a run first takes out what the log has, so that after an
interruption, and for prompts that repeat, nothing is asked twice. Replies that cannot be parsed are
asked for once more, with what was wrong; those prompts have keys of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..shared import discard, written
from . import drafts as X

#: Jobs that the open prompts are dealt over.
WAVES = 4
LOG = "key string, wave int, reply string, error string"
# What the second prompt says.
AGAIN = "The reply below could not be read as JSON. Send the corrected JSON only."


def key(prompt: Column, settings: str) -> Column:
    return F.sha2(F.concat_ws("\n", F.lit(settings), prompt), 256)


def folders(log: str) -> tuple[str, str]:
    """Where the first and the second replies are."""
    return f"{log}/asked", f"{log}/asked-again"


def logged(spark: SparkSession, log: str) -> DataFrame:
    """The log so far; of replies to one key that of a task that was run twice counts once."""
    try:
        return spark.read.schema(LOG).parquet(log).dropDuplicates(["key"])
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], LOG)


def ask(prompts: DataFrame, provider: X.Provider, log: str, waves: int = WAVES, stop_after: int | None = None) -> int:
    """Ask ``prompts(key, prompt)``, each key once, unless the log has it; the number of waves that were written.

    ``stop_after`` ends the run after so many waves, as an interruption would.
    """
    spark = prompts.sparkSession
    wave = F.pmod(F.xxhash64("key"), F.lit(waves)).cast("int")
    asked = waves if stop_after is None else min(waves, stop_after)
    keys = prompts.where(wave < asked).join(logged(spark, log).select("key"), "key", "left_anti")
    # Made once, a folder for each wave: a wave reads its own prompts, and no other's.
    open_ = written(keys.dropDuplicates(["key"]).select("key", "prompt", wave.alias("wave")), "open", "wave")
    for i in range(asked):
        replies = X.checked(X.call(open_.where(F.col("wave") == i), provider))
        replies.select("key", "wave", "reply", "error").write.mode("append").parquet(log)
    discard(open_)
    return asked


def run(prompts: DataFrame, provider: X.Provider, log: str, settings: str = "", waves: int = WAVES, stop_after: int | None = None) -> DataFrame:
    """``prompts(document_id, chunk, prompt)`` to ``(document_id, chunk, json, parse_status, error, asked)``.

    ``asked`` is how often the provider was asked for the final reply: 2 where the first one could
    not be read. A prompt without a reply has its error and is asked again by a later run only under
    other settings. Null prompts are not asked. Prompts of equal text share a reply.
    """
    spark = prompts.sparkSession
    # Two folders: Spark takes two scans of one folder for the same, though one saw fewer files.
    asked, asked_again = folders(log)
    named = written(prompts.where("prompt is not null").select("document_id", "chunk", "prompt", key(F.col("prompt"), settings).alias("key")), "prompts")
    ask(named.select("key", "prompt"), provider, asked, waves, stop_after)
    # A reply is parsed once for all prompts that share it, and prompts are read again for those that are asked again.
    first = written(X.parse(logged(spark, asked).select("key", "reply", "error")), "parsed")
    unread = first.where("parse_status = 'failed' and reply is not null").select("key", "reply")
    again = named.select("key", "prompt").join(unread, "key").dropDuplicates(["key"]).select(F.col("key").alias("first_key"), F.concat_ws("\n", F.lit(AGAIN), "reply", "prompt").alias("prompt"))
    again = written(again.withColumn("key", key(F.col("prompt"), settings)), "again")
    ask(again.select("key", "prompt"), provider, asked_again, waves, stop_after)
    second = X.parse(again.select("first_key", "key").join(logged(spark, asked_again).select("key", "reply", "error"), "key"))
    second = second.select(F.col("first_key").alias("key"), F.col("json").alias("json2"), F.col("parse_status").alias("status2"), F.col("error").alias("error2"))
    out = named.select("document_id", "chunk", "key").join(first, "key", "left").join(second, "key", "left")
    status = F.coalesce("status2", "parse_status")
    return out.select(
        "document_id", "chunk", F.coalesce("json2", "json").alias("json"), F.when(F.col("reply").isNull(), "unasked").otherwise(status).alias("parse_status"),
        F.coalesce("error2", "error").alias("error"), F.when(F.col("status2").isNotNull(), 2).when(F.col("reply").isNotNull() | F.col("error").isNotNull(), 1).otherwise(0).alias("asked"),
    )


def report(replies: DataFrame) -> DataFrame:
    """Chunks, failed chunks, chunks asked twice and the status of each document, from :func:`run`."""
    bad = F.col("json").isNull()
    n = replies.groupBy("document_id").agg(F.count("*").alias("chunks"), F.count_if(bad).alias("failed"), F.count_if(F.col("asked") == 2).alias("asked_twice"))
    return n.withColumn("status", F.when(F.col("failed") == 0, "ok").when(F.col("failed") < F.col("chunks"), "partial").otherwise("failed"))
