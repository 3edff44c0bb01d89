"""Names of a dictionary in texts by one automaton, however many names there are."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship

#: Bytes of names in one automaton; a larger dictionary is dealt over several, with a pass over the texts for each.
SHARD_BYTES = 8 << 20


def automaton(names: list[str]) -> ahocorasick.Automaton:
    made = ahocorasick.Automaton()
    for name in names:
        made.add_word(name, name)
    made.make_automaton()
    return made


def _found(shared, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = automaton(shared.value)
        for batch in batches:
            hits = [sorted({name for _, name in made.iter(t)}) if t else [] for t in batch["low"]]
            rows = batch[keys].loc[batch.index.repeat([len(h) for h in hits])]
            yield rows.assign(name_key=[name for h in hits for name in h])

    return run


def find(texts: DataFrame, names: DataFrame, keys: list[str], shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``texts(keys, text)`` and ``names(name)`` to ``(keys, name_key)``: which names, in lower case, occur anywhere in a text, each once.

    A text is read once for all names of a shard, and no name is held against every text. Names are
    distinct whatever their case; null and empty ones are left out, as are rows with a null key.
    """
    spark = ship(texts.sparkSession)
    distinct = names.select(F.lower("name").alias("name_key")).where("name_key <> ''").distinct()
    size = distinct.agg(F.sum(F.octet_length("name_key"))).first()[0] or 0
    n = max(1, -(-size // shard_bytes))
    low = texts.dropna(subset=keys).select(*keys, F.lower("text").alias("low"))
    schema = ", ".join([*(f"`{k}` {texts.schema[k].dataType.simpleString()}" for k in keys), "name_key string"])
    out = None
    for i in range(n):
        some = distinct.where(F.pmod(F.xxhash64("name_key"), F.lit(n)) == i) if n > 1 else distinct
        shared = spark.sparkContext.broadcast(sorted(r["name_key"] for r in some.collect()))
        if not shared.value:
            continue
        part = low.mapInPandas(_found(shared, keys), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], schema)
