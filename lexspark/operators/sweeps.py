"""Offsets and intervals inside documents by one pass in order, not by comparing all with all."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType
from pyspark.sql.window import Window

from ..shipping import ship


def last_before(points: DataFrame, starts: DataFrame, at: str, values: list[str], order: list[str] | None = None) -> DataFrame:
    """As-of: ``points(document_id, offset)``, each once, with ``values`` of the last row of ``starts`` whose ``at`` is at or before the offset.

    One window over both, each start before the points at its offset; of equal starts the last by ``order``.
    """
    row = F.struct(*values)
    mark = starts.select("document_id", F.col(at).cast("long").alias("offset"), F.lit(0).alias("turn"), F.struct(*(order or values)).alias("nth"), row.alias("value"))
    ask = points.select("document_id", F.col("offset").cast("long").alias("offset")).distinct()
    kinds = dict(mark.dtypes)
    ask = ask.select("document_id", "offset", F.lit(1).alias("turn"), F.lit(None).cast(kinds["nth"]).alias("nth"), F.lit(None).cast(kinds["value"]).alias("value"))
    w = Window.partitionBy("document_id").orderBy("offset", "turn", "nth").rowsBetween(Window.unboundedPreceding, 0)
    swept = mark.unionByName(ask).withColumn("value", F.last("value", ignorenulls=True).over(w)).where("turn = 1 and value is not null")
    kind = points.schema["offset"].dataType
    return swept.select("document_id", F.col("offset").cast(kind).alias("offset"), "value.*")


def by_document(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` with all of a document in one task, in order, for a function that reads partitions.

    A window asks for both, which holds however partitions are merged at run time. A repartition
    does not: over a union of tables that are dealt by document already it is taken out as needless,
    and the two tables may then be merged into partitions by themselves.
    """
    w = Window.partitionBy("document_id").orderBy(*order)
    return rows.withColumn("__nth", F.row_number().over(w)).where("__nth > 0").drop("__nth")


def _swept(names: list[str]):
    """Events in order to pairs of open intervals of the two sides; what is open is all that is kept."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        document, active = None, (set(), set())
        for batch in batches:
            out: list[tuple] = []
            for doc, turn, side, left, right in zip(*(batch[c].tolist() for c in ("document_id", "turn", "side", "left", "right")), strict=True):
                if doc != document:
                    document, active = doc, (set(), set())
                own = right if side else left
                if turn:
                    active[side].discard(own)
                    continue
                active[side].add(own)
                out += [(doc, left, y) for y in active[1]] if not side else [(doc, x, right) for x in active[0]]
            yield pd.DataFrame(out, columns=names)

    return run


def overlaps(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> DataFrame:
    """``(document_id, left_id, right_id)`` of the intervals ``(document_id, id, lo, hi)`` that share an offset, ends included.

    Ids are unique in a document and side. Every interval opens and closes once, in order; a pair
    comes out where the later of the two opens. So the work is that of a sort and of the result.
    Intervals with nulls or with ``hi`` below ``lo`` hold nothing.
    """
    ship(left.sparkSession)
    sides = [(left, left_id, "left", 0), (right, right_id, "right", 1)]
    kinds = {name: table.schema[key].dataType for table, key, name, _ in sides}
    tables = []
    for table, key, name, side in sides:
        good = table.where("document_id is not null and lo is not null and hi >= lo").where(F.col(key).isNotNull())
        ids = [(F.col(key) if name == n else F.lit(None).cast("string")).cast("string").alias(n) for n in kinds]
        tables.append(good.select("document_id", *ids, F.lit(side).alias("side"), F.explode(F.array(F.struct(F.col("lo").cast("long").alias("at"), F.lit(0).alias("turn")), F.struct(F.col("hi").cast("long").alias("at"), F.lit(1).alias("turn")))).alias("e")))
    events = tables[0].unionByName(tables[1]).select("document_id", "left", "right", "side", "e.at", "e.turn")
    in_order = by_document(events, "at", "turn").select("document_id", "turn", "side", "left", "right")
    schema = StructType([StructField("document_id", left.schema["document_id"].dataType), StructField("left", in_order.schema["left"].dataType), StructField("right", in_order.schema["right"].dataType)])
    pairs = in_order.mapInPandas(_swept(["document_id", "left", "right"]), schema)
    return pairs.select("document_id", F.col("left").cast(kinds["left"]).alias(left_id), F.col("right").cast(kinds["right"]).alias(right_id))


def innermost(points: DataFrame, intervals: DataFrame, key: str, rank: Column) -> DataFrame:
    """``points(document_id, offset)``, each once, with the ``key`` of the interval ``[start_offset, end_offset)`` of lowest ``rank`` around each, where there is one."""
    at = points.select("document_id", "offset", F.col("offset").alias("lo"), F.col("offset").alias("hi")).distinct()
    spans = intervals.select("document_id", key, F.col("start_offset").alias("lo"), (F.col("end_offset") - 1).alias("hi"))
    around = overlaps(at, spans, "offset", key).join(intervals.select("document_id", key, rank.alias("rank")), ["document_id", key])
    return around.groupBy("document_id", "offset").agg(F.min_by(key, "rank").alias(key))
