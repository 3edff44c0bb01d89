"""Mixing sources to target weights by the cube method (Deville and Tille, 2004).

Each document of a source gets the same inclusion count, target over size; its whole part is taken
at once, and the fractional part is an inclusion probability. The flight phase moves these
probabilities along the null space of two constraints, the number of documents and the words
taken, until at most two documents of a block are undecided. The undecided of all blocks of a source
form new blocks, with a few decided ones beside them that may still change, and so on, until the
source has one block left, which the landing phase rounds. How a source is landed depends on that source alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import materialize, n_words

#: Documents of one flight; bounds what a task holds.
BLOCK = 1_000
#: Part of a block that goes on beside its undecided documents, so that the landing has what to exchange.
SPARE = 0.25
#: Most times that a document may be taken.
MOST = 3
EPS = 1e-9


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST) -> DataFrame:
    """``sizes(source, source_size)`` to the same with ``target``, in words.

    Sources by code point, null last, have the weights in turn. A target above ``most`` times its
    source's size stops there and the excess is shared among the others by weight. Ordered by
    size over weight, the sources that stop come first: one does if its limit is below its share
    of what those before it leave.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    n = len(weights)
    w = sizes.withColumn("place", F.row_number().over(order) - 1).withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % n + 1).cast("int")))
    w = w.withColumn("limit", F.col("source_size") * float(most))
    by_limit = Window.orderBy(F.col("limit") / F.col("w"), "place")
    before, on, everything = by_limit.rowsBetween(Window.unboundedPreceding, -1), by_limit.rowsBetween(0, Window.unboundedFollowing), Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))
    w = w.withColumn("level", left / F.sum("w").over(on)).withColumn("stops", F.col("limit") <= F.col("level") * F.col("w"))
    first = F.min(F.when(~F.col("stops"), F.struct((F.col("limit") / F.col("w")).alias("at"), "place", "level"))).over(everything)
    return w.withColumn("level", F.coalesce(first["level"], F.lit(0.0))).withColumn("target", F.when(F.col("stops"), F.col("limit")).otherwise(F.least(F.col("limit"), F.col("level") * F.col("w")))).select("source", "source_size", "target")


def flight(chance: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Move probabilities, keeping their sum and the expected size, until at most two are fractional.

    Three undecided documents always have a direction in the null space: steps proportional to
    (s2 - s3, s3 - s1, s1 - s2). Of the two ways along it the one that the documents' order
    prefers by chance is fixed by a hash of the values, so that a rerun agrees.
    """
    p = chance.astype(float).tolist()
    s = size.astype(float).tolist()
    open_: list[int] = []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (s[b] - s[c], s[c] - s[a], s[a] - s[b])
            if u == (0.0, 0.0, 0.0):
                u = (1.0, -1.0, 0.0)
            up = min((1 - p[x]) / v if v > 0 else p[x] / -v for x, v in zip(open_, u, strict=True) if v)
            down = min(p[x] / v if v > 0 else (1 - p[x]) / -v for x, v in zip(open_, u, strict=True) if v)
            draw = xxhash.xxh3_64_intdigest(repr((a, b, c, i, s[a], s[b], s[c]))) / 2.0**64
            step = up if draw * (up + down) < down else -down
            for x, v in zip(open_, u, strict=True):
                p[x] = min(1.0, max(0.0, p[x] + step * v))
            open_ = [x for x in open_ if EPS < p[x] < 1 - EPS]
    return np.array([round(x) if not EPS < x < 1 - EPS else x for x in p])


def landing(before: np.ndarray, after: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last undecided documents, then change decisions until the words are near what they were before the flight.

    A very long document stays undecided, since its steps are small beside those of the others, and
    rounding it misses by up to half its length. So of each rounding the longest decisions that do
    not overshoot are changed, then at most two more, those that come nearest in words, then in
    number of documents; the rounding that comes nearest is kept.
    """
    words, docs = float(before @ size), float(before.sum())
    open_ = [i for i, x in enumerate(after) if EPS < x < 1 - EPS]
    best: tuple = (np.inf, np.inf, None)
    longest = np.argsort(-size, kind="stable")
    for m in range(2 ** len(open_)):
        taken = after.copy()
        taken[open_] = [m >> k & 1 for k in range(len(open_))]
        off = float(taken @ size) - words
        for i in longest:
            if taken[i] == (off > 0) and size[i] <= abs(off):
                taken[i], off = 1 - taken[i], off - size[i] * np.sign(off)
        sign = 1 - 2 * taken
        off, many = float(taken @ size) - words, float(taken.sum()) - docs
        change = np.append(sign * size, 0.0)
        count = np.append(sign, 0.0)
        for i in range(len(change)):
            miss = np.abs(off + change[i] + change[i:])
            miss[:1] = abs(off + change[i])
            j = int(np.argmin(miss))
            got = (float(miss[j]), abs(many + count[i] + (count[i + j] if j else 0.0)))
            if got < best[:2]:
                flips = {i, i + j} - {len(size)}
                best = (*got, np.array([1 - x if k in flips else x for k, x in enumerate(taken)]))
    return best[2] if best[2] is not None else after


def _carried(most: int) -> int:
    """Documents that a block of ``most`` hands on: two undecided and some spare ones, at most half of it."""
    return 2 + int(SPARE * most)


def _spread(size: np.ndarray, among: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` of the places ``among``, spread evenly over their sizes, the smallest and the largest included."""
    ordered = among[np.argsort(size[among], kind="stable")]
    return ordered[np.unique(np.linspace(0, len(ordered) - 1, min(n, len(ordered))).round().astype(int))]


def _fly(most: int):
    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["turn", "size"], kind="stable").reset_index(drop=True)
        before, size = block["chance"].to_numpy(float), block["size"].to_numpy(float)
        p = flight(before, size)
        onward = np.zeros(len(p), bool)
        if block["blocks"].iloc[0] <= 1:
            p = landing(before, p, size)
        else:
            onward = (EPS < p) & (p < 1 - EPS)
            onward[_spread(size, np.flatnonzero(~onward), _carried(most) - 2)] = True
        return block.assign(chance=p, onward=onward, blocks=-(-_carried(most) * block["blocks"] // most))[["row", "source", "size", "turn", "chance", "blocks", "onward"]]

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = MOST, block: int = BLOCK, seed: int = 17) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``(doc_id, size, source_size, target, taken, source)``, one row a document.

    ``size`` is the number of words, ``taken`` the words that the mix takes from the document with
    repeats: 0 to ``most`` times ``size``. The words taken from a source come within a short document
    of its target, however long its longest one is, as long as the documents of its last block, at
    least half of ``block`` if it had more than one, hold the words to exchange for it.

    A null or empty text has size 0 and is taken 0 times. A null source is a source of its own,
    last in order. Rows that repeat in id, source and size get the same number of copies, so that
    a rerun agrees whatever the partitions. An empty table gives an empty result.
    """
    if block < 8:
        raise ValueError("a block holds at least 8 documents")
    ship(docs.sparkSession)
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words("text").alias("size")), "sizes")
    per_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum((F.col("size") > 0).cast("long")).alias("filled"))
    goal = materialize(targets(per_source.select("source", "source_size"), weights, share, most).join(per_source.select(F.col("source").alias("s"), "filled"), F.col("source").eqNullSafe(F.col("s"))).drop("s"), "targets")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # Nearly whole rates are whole: no flight is needed for their rounding error.
    whole = F.least(F.lit(most), F.floor(rate + 1e-9)).cast("long")
    named = goal.withColumn("whole", whole).withColumn("part", F.greatest(F.lit(0.0), rate - whole))
    rows = sized.where("size > 0").groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies"))
    key = F.xxhash64(F.lit(seed), "doc_id", "source", "size")
    # One row for each distinct document; its repeats weigh in its size.
    units = rows.select(F.struct("doc_id", "source", "size").alias("row"), "source", (F.col("size") * F.col("copies")).alias("size"), key.alias("turn"))
    plan = named.select(F.col("source").alias("s"), F.col("part").alias("chance"), F.ceil(F.col("filled") / block).alias("blocks"))
    live = units.join(plan, F.col("source").eqNullSafe(F.col("s"))).drop("s").where("chance > 0")
    schema = "row struct<doc_id:bigint,source:string,size:bigint>, source string, size bigint, turn bigint, chance double, blocks bigint, onward boolean"
    most_blocks = plan.agg(F.coalesce(F.max("blocks"), F.lit(1))).first()[0]
    chosen, level = None, 0
    while True:
        blocks = live.select("row", "source", "size", "turn", "chance", "blocks", F.pmod(F.xxhash64(F.lit(level), "turn"), F.greatest("blocks", F.lit(1))).alias("block"))
        done = materialize(blocks.groupBy("source", "block").applyInPandas(_fly(block), schema), "flight")
        taken = done.where(~F.col("onward") & (F.col("chance") >= 1 - EPS)).select("row")
        chosen = taken if chosen is None else chosen.unionByName(taken)
        if most_blocks <= 1:
            break
        live = done.where("onward")
        most_blocks, level = -(-_carried(block) * most_blocks // block), level + 1
    extra = chosen.select("row.doc_id", "row.source", "row.size", F.lit(1).cast("long").alias("more"))
    marked = sized.join(extra, [sized[c].eqNullSafe(extra[c]) for c in ("doc_id", "source", "size")], "left").select(sized["doc_id"], sized["source"], sized["size"], "more")
    out = marked.join(named.select(F.col("source").alias("s"), "source_size", "target", "whole"), F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * (F.col("whole") + F.coalesce("more", F.lit(0)))).alias("taken"), "source")
