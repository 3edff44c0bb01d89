"""Tables in the folder that driver and executors share: where work is cut and reused."""

from __future__ import annotations

import os
import tempfile
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset a local folder, in local mode only."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = os.path.join(tempfile.gettempdir(), "lexspark-shared")
    os.makedirs(made, exist_ok=True)
    return f"file://{made}"


def written(df: DataFrame, tag: str, *by: str) -> DataFrame:
    """``df`` as Parquet in the shared folder, read back: work above it is done once, and not again when an executor is lost; ``by`` are columns with few values, each with folders of its own."""
    path = f"{shared_dir(df.sparkSession)}/lexspark-{tag}-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_document(rows: DataFrame, dealt: bool = False) -> DataFrame:
    """Rows dealt out by ``deal``, a hash of the document, for steps within a document, whose windows start with ``deal, document_id``.

    A hash and not the id: Spark 4.1 takes a repartition by the id out where all sides of a union are
    dealt out by it, and may then put the sides into partitions by themselves. The number is the
    session's: few bytes make many rows, which a number by bytes would put into one task.

    Rows that are ``dealt`` lie by document already, all sides of a union by a repartition with that
    number, which Spark leaves as it is; they stay where they are.
    """
    if dealt:
        return rows.withColumn("deal", F.lit(0))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.withColumn("deal", F.xxhash64("document_id")).repartition(n, "deal")


def meet(rows: DataFrame, others: DataFrame, keys: list[str], how: str, dealt: bool = False) -> DataFrame:
    """``rows`` joined with ``others`` on ``keys``, the document among them: ``inner``, ``left``, ``left_semi`` or ``left_anti``; of ``dealt`` tables by a window, for which nothing is dealt out again."""
    if not dealt:
        return rows.join(others, keys, how)
    rest, more = ([c for c in t.columns if c not in keys] for t in (rows, others))
    one = F.lit(1).alias("one")
    known = others.dropna(subset=keys).select(*keys, F.struct(one, *(more if how in ("inner", "left") else [])).alias("other"))
    met = by_document(rows.select(*keys, F.struct(one, *rest).alias("row")).unionByName(known, allowMissingColumns=True), dealt)
    met = met.withColumn("others", F.collect_list("other").over(Window.partitionBy("deal", *keys))).where("row is not null")
    own = [*keys, *[f"row.{c}" for c in rest]]
    if how in ("left_semi", "left_anti"):
        return met.where(F.size("others") > 0 if how == "left_semi" else F.size("others") == 0).select(own).select(rows.columns)
    each = met.withColumn("other", F.explode_outer("others") if how == "left" else F.explode("others"))
    return each.select(*own, *[f"other.{c}" for c in more])


def without(rows: DataFrame, others: DataFrame, keys: list[str], dealt: bool = False) -> DataFrame:
    """``rows`` whose ``keys`` are not in ``others``."""
    return meet(rows, others.select(keys), keys, "left_anti", dealt)


def written_tables(tag: str, *tables: DataFrame) -> list[DataFrame]:
    """The tables as :func:`written`, in one run, so that steps they share are done once."""
    stacked = [t.select(F.struct(*t.columns).alias(f"t{i}"), F.lit(i).alias("of")) for i, t in enumerate(tables)]
    every = written(reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), stacked), tag, "of")
    return [every.where(F.col("of") == i).select(f"t{i}.*") for i in range(len(tables))]


def lay(table: DataFrame) -> DataFrame:
    """A written table dealt out once, by document, for steps that read it several times.

    The columns travel in a list of one entry, which hides them from Spark, and no filter passes the
    partition's number: all steps of a job read the same exchange.
    """
    n = int(table.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = F.array(F.struct(*[c for c in table.columns if c != "document_id"])).alias("every")
    hidden = F.when(F.spark_partition_id() >= 0, F.col("every")).alias("every")
    return table.select("document_id", rest).repartition(n, "document_id").select("document_id", hidden).select("document_id", F.inline("every")).select(table.columns)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder of any store that Spark reads."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def discard(*tables: DataFrame) -> None:
    """Delete what :func:`written` wrote, once nothing reads it any more."""
    for df in tables:
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            delete(df.sparkSession, path)
