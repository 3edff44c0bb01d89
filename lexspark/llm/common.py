"""What the operators of this subpackage share: written intermediate tables and text helpers."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..shipping import ship

#: One word of the contracts: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows, and bytes of them, that a Python worker holds at once; texts can be long. A longer row comes alone.
BATCH, BATCH_BYTES = 1_000, 8 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset a local one, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = "file://" + os.path.join(tempfile.gettempdir(), "lexspark-shared")
    os.makedirs(made.removeprefix("file://"), exist_ok=True)
    return made


#: What this Python worker holds between the tasks of one table: models, by a name of their training.
HELD: dict = {}
_ENTERED: list[str] = []


def held(name: str, make):
    """The object of that name, made once in a worker; only one is held at a time."""
    if name not in HELD:
        HELD.clear()
        HELD[name] = make()
    return HELD[name]


def _give_back() -> None:
    """Return freed memory to the system: a worker is used again for later tables, and what it keeps adds to theirs."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # a C library without it
        return


def _enter(table: str) -> None:
    """Drop what an earlier table left in the worker."""
    if _ENTERED != [table]:
        HELD.clear()
        _ENTERED[:] = [table]
        _give_back()


def _frame(batch: pa.RecordBatch) -> pd.DataFrame:
    """The batch in pandas; whole numbers beside nulls stay Python numbers and never become floats."""
    return batch.to_pandas(integer_object_nulls=True)


def _pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Runs of rows of at most :data:`BATCH` rows and about :data:`BATCH_BYTES`."""
    todo = [batch]
    while todo:
        part = todo.pop()
        n = part.num_rows
        if n > BATCH or (n > 1 and part.nbytes > BATCH_BYTES):
            todo += [part.slice(n // 2), part.slice(0, n // 2)]
        else:
            yield part


def _bounded(run, table: str, schema: pa.Schema):
    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from map(_frame, _pieces(batch))

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _enter(table)
        for out in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=schema, preserve_index=False)
        _give_back()

    return one


def map_batches(df: DataFrame, run, schema: str | StructType) -> DataFrame:
    """``run`` over frames of at most :data:`BATCH` rows, with this package on the executors.

    Whole numbers come and go as they are: beside nulls a column holds Python numbers and None, so
    that an id of 64 bits does not depend on the rows that share its batch.
    """
    ship(df.sparkSession)
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return df.mapInArrow(_bounded(run, uuid.uuid4().hex, to_arrow_schema(kind)), schema)


def shared_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/lexspark-{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    The lineage ends there, so a lost executor never causes upstream work to be redone, and work
    in Python runs once.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`materialize` wrote, once nothing reads it any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def n_words(text: Column | str) -> Column:
    """Words of a text by :data:`WORD`; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_limit(share: float) -> int:
    """The signed 64-bit hash up to which this share of hashes lies; never below the smallest few, whatever the number of texts."""
    return min(2**63 - 1, -(2**63) + max(1, int(share * 2**64)))


#: A key with more than this share of the rows is hot, so fewer than 1 / HOT_SHARE keys are.
HOT_SHARE = 0.001


def look_up(rows: DataFrame, table: DataFrame, key: str, total: int, number: str = "members") -> DataFrame:
    """``rows`` left-joined to ``table``, which has one row a key and in ``number`` how many rows have the key.

    The rows of hot keys stay where they are: fewer than 1 / HOT_SHARE keys are hot, so these are
    broadcast. The others are shuffled, and none of their keys fills a task. Both tables should be written ones.
    """
    hot = F.broadcast(table.where(F.col(number) > total * HOT_SHARE).drop(number))
    cold = table.where(F.col(number) <= total * HOT_SHARE).drop(number)
    return rows.join(hot, key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left"))
