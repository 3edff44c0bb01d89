"""The stage tracker of document runs as a stateful stream.

Each run keeps one state, whatever the batches: of every stage the latest report, and the latest ones
that started and ended it. A report counts by its number and not by when it comes, so late and
repeated reports change nothing that they should not, and any split into batches ends in one table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..shipping import ship

# The stages in order, and the words for what became of one.
STAGES = ["received", "text-extracted", "clauses-identified", "entities-extracted", "relationships-built", "evidence-validated", "workspace-ready"]
STATUSES = ["pending", "active", "done", "failed", "skipped"]

REPORTS = "run_id string, seq long, at timestamp, stage string, status string, message string"
ROWS = "run_id string, stage string, place int, status string, seq long, started_at timestamp, ended_at timestamp, message string"


def taken(state: dict, seq: int, at: str | None, stage: str, status: str | None, message: str | None) -> None:
    """Put a report into the state of its run; one of an unknown stage is left out, one without status says done."""
    if stage not in STAGES:
        return
    now = state.setdefault(stage, {})
    status = status or "done"

    def latest(name: str, value) -> None:
        if name not in now or now[name][0] < seq:
            now[name] = [seq, value]

    latest("status", status)
    if message is not None:
        latest("message", message)
    if status == "active":
        latest("started", at)
    if status in ("done", "failed"):
        latest("ended", at)


def shown(run_id: str, state: dict) -> pd.DataFrame:
    """All stages of a run; those without a report are pending, or skipped after one that has failed."""
    rows, failed = [], False
    for place, stage in enumerate(STAGES):
        now = state.get(stage, {})
        of = lambda name: now.get(name, [None, None])  # noqa: B023, E731
        seq, status = of("status")
        rows.append((run_id, stage, place, status or ("skipped" if failed else "pending"), seq, of("started")[1], of("ended")[1], of("message")[1]))
        failed = failed or status == "failed"
    out = pd.DataFrame(rows, columns=["run_id", "stage", "place", "status", "seq", "started_at", "ended_at", "message"])
    # Numbers stay whole and times stay times beside nulls.
    return out.astype({"seq": "Int64", "started_at": "datetime64[ns]", "ended_at": "datetime64[ns]"})


def _track(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
    state = json.loads(kept.get[0]) if kept.exists else {}
    for frame in frames:
        for seq, at, stage, status, message in zip(frame["seq"], frame["at"], frame["stage"], frame["status"], frame["message"], strict=True):
            taken(state, int(seq), None if pd.isna(at) else str(at), stage, status, message)
    kept.update((json.dumps(state),))
    yield shown(key[0], state)


def track(reports: DataFrame) -> DataFrame:
    """A stream of ``reports`` to the stages of every run that a batch has reports of."""
    ship(reports.sparkSession)
    known = reports.where("run_id is not null and seq is not null")
    return known.groupBy("run_id").applyInPandasWithState(_track, ROWS, "state string", "update", GroupStateTimeout.NoTimeout)


def run(spark: SparkSession, source: str, table: str, checkpoint: str, files_a_batch: int = 1) -> StreamingQuery:
    """Track the Parquet files of ``source`` that are new since ``checkpoint`` into ``table``: a folder for each batch, so that a batch that is run twice is there once."""

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")

    stream = spark.readStream.schema(REPORTS).option("maxFilesPerTrigger", files_a_batch).parquet(source)
    return track(stream).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The stages of each run after the last batch that had reports of it."""
    rows = spark.read.schema(f"{ROWS}, batch int").parquet(table)
    last = rows.groupBy("run_id").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["run_id", "batch"]).drop("batch")
