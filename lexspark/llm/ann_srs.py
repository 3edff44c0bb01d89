"""Nearest neighbours by stable random projections and kd-trees (SRS; Sun et al., 2014).

Vectors go to a few dimensions by a Gaussian projection, in which the squared projected distance
over the squared distance of a pair follows a chi-square law. Cells of a coarse kd-tree over the
projections, learnt from a bounded sample, deal all vectors into blocks; each block has a kd-tree of
its own, built once and stored. A query goes to its nearest cell first; what it finds there bounds
its search, and it then goes only to blocks that the bound leaves. In a block it takes the leaves by
increasing projected distance, verifies exactly the vectors that are near in the projection, and
stops once the chi-square law says that a vector nearer than the k-th found would have shown up
with the wanted probability. Blocks stay where they are and queries stream past them.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .common import discard, hash_limit, map_batches, materialize

#: Projected dimensions, an even number; vectors of a block; vectors of a leaf.
DIMS, BLOCK, LEAF = 24, 16_384, 128
#: Bounds of the coarse tree: vectors of the sample that it is learnt from, and its cells. A cell
#: with more vectors than a block is split by hash.
SAMPLE, CELLS = 20_000, 1_024
#: The wanted probability that a nearer vector would have been met.
SURE = 0.95
SEED = 11


def chi_square(x: float, dims: int) -> float:
    """The distribution function for an even number of dimensions."""
    term = total = 1.0
    for i in range(1, dims // 2):
        term *= x / 2 / i
        total += term
    return 1 - math.exp(-x / 2) * total


def chi_square_point(p: float, dims: int) -> float:
    low, high = 0.0, 1_000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, dims) < p else (low, mid)
    return high


def projection(width: int, to: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width + 1, to))


def placed(vectors: np.ndarray, plane: np.ndarray, top: float) -> np.ndarray:
    """Projections of vectors with one more coordinate that makes all of them as long as the longest.

    ``top`` is at least every squared length. The largest inner product then is the smallest
    distance to a query, whose own additional coordinate is zero.
    """
    length = (vectors * vectors).sum(axis=1)
    return vectors @ plane[:-1] + np.sqrt(np.maximum(top - length, 0.0))[:, None] * plane[-1]


def gaps(at: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each point to each box."""
    out = np.zeros((len(at), len(low)))
    for d in range(at.shape[1]):
        x = at[:, d : d + 1]
        gap = np.maximum(np.maximum(low[:, d] - x, x - high[:, d]), 0.0)
        out += gap * gap
    return out


class Tree:
    """A kd-tree that splits the widest dimension at the median; leaves are runs of ``order`` with a box each."""

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.order = np.arange(len(points))
        bounds: list[tuple[int, int]] = []
        #: Splits in the order in which a point meets them: ``(axis, value, node if below, node if not)``, leaves as -1 - number.
        self.splits: list[list] = []
        todo = [(0, len(points), -1, 0)]
        while todo:
            a, b, above, side = todo.pop()
            run = self.order[a:b]
            box = points[run]
            if b - a <= leaf:
                bounds.append((a, b))
                self._hang(above, side, -len(bounds))
                continue
            axis = int(np.argmax(box.max(axis=0) - box.min(axis=0)))
            mid = (b - a) // 2
            part = np.argpartition(box[:, axis], mid, kind="introselect")
            self.order[a:b] = run[part]
            self._hang(above, side, len(self.splits))
            self.splits.append([axis, float(box[part[mid], axis]), 0, 0])
            todo += [(a, a + mid, len(self.splits) - 1, 2), (a + mid, b, len(self.splits) - 1, 3)]
        self.leaves = bounds
        self.low = np.array([points[self.order[a:b]].min(axis=0) for a, b in bounds])
        self.high = np.array([points[self.order[a:b]].max(axis=0) for a, b in bounds])

    def _hang(self, above: int, side: int, node: int) -> None:
        if above >= 0:
            self.splits[above][side] = node

    def leaf_of(self, points: np.ndarray) -> np.ndarray:
        """The leaf in whose part of the space each point lies."""
        out = np.zeros(len(points), np.int64)
        todo = [(0 if self.splits else -1, np.arange(len(points)))]
        while todo:
            node, who = todo.pop()
            if node < 0:
                out[who] = -1 - node
                continue
            axis, value, below, above = self.splits[node]
            less = points[who, axis] < value
            todo += [(below, who[less]), (above, who[~less])]
        return out


class Block:
    """The vectors of a block in the order of their tree's leaves, with their projections and the leaves' boxes."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, plane: np.ndarray, top: float):
        points = placed(vectors, plane, top)
        tree = Tree(points)
        self.ids, self.vectors, self.points = ids[tree.order], vectors[tree.order], points[tree.order]
        self.leaves, self.low, self.high, self.top = tree.leaves, tree.low, tree.high, top
        self.size = (self.points * self.points).sum(axis=1)
        #: Whether an id has several vectors.
        self.repeats = len(np.unique(ids)) < len(ids)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, at: np.ndarray, k: int, limit: float, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
        """The ``k`` best ids of the block for each query with a projection ``at``, and their inner products, best first; minus infinity where there are fewer.

        ``bound`` is a score that each query has ``k`` others at or above. Returns also how many
        leaves were visited and how many vectors verified.
        """
        gap = gaps(at, self.low, self.high)
        turn = np.argsort(gap, axis=1, kind="stable")
        gap = np.take_along_axis(gap, turn, axis=1)
        own, own_at = (queries * queries).sum(axis=1), (at * at).sum(axis=1)
        n, visited, verified = len(queries), 0, 0
        best_id, best = np.full((n, k), np.iinfo(np.int64).max), np.full((n, k), -np.inf)
        live = np.arange(n)
        for step in range(len(self.leaves)):
            # A nearer vector than the k-th would project to within this distance with the wanted probability.
            reach = limit * np.maximum(own[live] + self.top - 2 * np.maximum(best[live, -1], bound[live]), 0.0) + 1e-9 * self.top
            more = gap[live, step] <= reach
            live, reach = live[more], reach[more]
            if not len(live):
                break
            visited += len(live)
            for leaf in np.unique(turn[live, step]):
                here = turn[live, step] == leaf
                who = live[here]
                a, b = self.leaves[leaf]
                apart = own_at[who][:, None] + self.size[a:b] - 2 * at[who] @ self.points[a:b].T
                near = apart <= reach[here][:, None]
                near &= self.ids[a:b] != query_ids[who][:, None]
                verified += int(near.sum())
                score = np.where(near, queries[who] @ self.vectors[a:b].T, -np.inf)
                better = (score >= np.maximum(best[who, -1], bound[who])[:, None]).any(axis=1)
                if not better.any():
                    continue
                who, score = who[better], score[better]
                s = np.concatenate([best[who], score], axis=1)
                i = np.concatenate([best_id[who], np.broadcast_to(self.ids[a:b], score.shape)], axis=1)
                if self.repeats:  # of an id's vectors the best counts
                    by_id = np.lexsort((-s, i), axis=1)
                    s, i = np.take_along_axis(s, by_id, axis=1), np.take_along_axis(i, by_id, axis=1)
                    s[:, 1:][i[:, 1:] == i[:, :-1]] = -np.inf
                first = np.lexsort((i, -s), axis=1)[:, :k]
                best[who], best_id[who] = np.take_along_axis(s, first, axis=1), np.take_along_axis(i, first, axis=1)
        return best_id, best, visited, verified


def _usable(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows whose vector is not null, empty or zero and has only finite components, as 64-bit floats."""
    for batch in batches:
        rows = []
        for vec_id, v in zip(batch["vec_id"], batch["embedding"], strict=True):
            if v is None or pd.isna(vec_id):
                continue
            x = np.array(v, dtype=float) if len(v) else np.zeros(0)
            if len(x) and np.isfinite(x).all() and x.any():
                rows.append((int(vec_id), x.tobytes(), len(x), float(x @ x)))
        yield pd.DataFrame(rows, columns=["vec_id", "v", "width", "length"])


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(vectors)).reshape(len(vectors), -1)


class Cells:
    """The coarse tree of one vector length: which cell a projection lies in, and after :meth:`fit` the boxes of the cells."""

    def __init__(self, sample: np.ndarray, n: int, top: float, dims: int, block: int):
        self.plane, self.top = projection(sample.shape[1], dims), top
        want = min(CELLS, max(1, -(-n // block)))
        self.tree = Tree(placed(sample, self.plane, top), leaf=max(1, -(-len(sample) // want)))

    def of(self, vectors: np.ndarray) -> np.ndarray:
        return self.tree.leaf_of(placed(vectors, self.plane, self.top))


def _celled(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby("width", sort=False):
                cells: Cells = shared.value[width]
                vectors = _matrix(part["v"])
                points = placed(vectors, cells.plane, cells.top)
                yield part[["vec_id", "v", "width"]].assign(cell=cells.tree.leaf_of(points), low=list(points), high=list(points))

    return run


def _packed(shared):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["vec_id", "v"], kind="stable")
        cells: Cells = shared.value[int(part["width"].iloc[0])]
        block = Block(part["vec_id"].to_numpy(np.int64), _matrix(part["v"]), cells.plane, cells.top)
        return part[["width", "cell", "part"]].head(1).assign(block=pickle.dumps(block, protocol=5))

    return run


def _routed(shared, boxes, limit: float, first: bool):
    """Queries ``(query_id, v, width, bound)`` to ``(..., cell, part)``: the nearest cell's one part, or all other blocks within the bound."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for width, part in batch.groupby("width", sort=False):
                cells: Cells = shared.value[width]
                numbers, parts, low, high = boxes.value[width]
                queries = _matrix(part["v"])
                gap = gaps(queries @ cells.plane[:-1], low, high)
                home = gap.argmin(axis=1)
                home_part = part["query_id"].to_numpy(np.int64) % parts[home]
                if first:
                    yield part[["query_id", "v", "width", "bound"]].assign(cell=numbers[home], part=home_part)
                    continue
                reach = limit * np.maximum((queries * queries).sum(axis=1) + cells.top - 2 * part["bound"].to_numpy(float), 0.0) + 1e-9 * cells.top
                for at in range(0, len(part), 64):  # a query may go to many blocks
                    who, to = np.nonzero(gap[at : at + 64] <= reach[at : at + 64, None])
                    who += at
                    many = parts[to]
                    who, to = np.repeat(who, many), np.repeat(to, many)
                    number = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
                    other = (to != home[who]) | (number != home_part[who])
                    yield part[["query_id", "v", "width", "bound"]].iloc[who[other]].assign(cell=numbers[to[other]], part=number[other])

    return run


def _searched(shared, k: int, limit: float):
    """Rows by block, the block first, then its queries: queries stream past the block that the task holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, key = None, None
        for batch in batches:
            for now, part in batch.groupby(["width", "cell", "part"], sort=False):
                held = part["block"].notna()
                if held.any():
                    block, key = pickle.loads(part.loc[held, "block"].iloc[0]), now
                asked = part[~held]
                if not len(asked):
                    continue
                if key != now:
                    raise ValueError(f"no block {now} for its queries")
                who, queries = asked["query_id"].to_numpy(np.int64), _matrix(asked["v"])
                found, score, visited, verified = block.search(queries, who, queries @ shared.value[now[0]].plane[:-1], k, limit, asked["bound"].to_numpy(float))
                keep = ~np.isinf(score)
                out = pd.DataFrame({"query_id": np.repeat(who, found.shape[1])[keep.ravel()], "vec_id": found[keep], "score": score[keep]})
                yield out.assign(visited=0, verified=0)
                yield pd.DataFrame({"query_id": [None], "vec_id": [None], "score": [0.0], "visited": [visited], "verified": [verified]})

    return run


def _search(blocks: DataFrame, routed: DataFrame, shared, k: int, limit: float) -> DataFrame:
    keys = ["width", "cell", "part"]
    empty = lambda kind: F.lit(None).cast(kind)
    stay = blocks.select(*keys, F.lit(0).alias("kind"), "block", empty("long").alias("query_id"), empty("binary").alias("v"), empty("double").alias("bound"))
    move = routed.select(*keys, F.lit(1).alias("kind"), empty("binary").alias("block"), "query_id", "v", "bound")
    # One hash partition a block or so; in it each block comes before its queries.
    rows = stay.unionByName(move).repartition(max(1, blocks.count()), *keys).sortWithinPartitions(*keys, "kind").drop("kind")
    return map_batches(rows, _searched(shared, k, limit), "query_id long, vec_id long, score double, visited long, verified long")


def nearest(vectors: DataFrame, is_query, k: int = 20, sure: float = SURE, dims: int = DIMS, block: int = BLOCK, work: list | None = None) -> DataFrame:
    """``vectors(vec_id, embedding)`` to the ``k`` largest inner products of each query: ``(query_id, rank, vec_id, score)``.

    ``is_query`` is a condition on ``vec_id``. All usable vectors are indexed and are candidates,
    but for the query's own id. Scores are inner products of the original vectors in double
    precision; ties go to the smaller id. ``work``, if given, gets the numbers of leaves visited
    and of vectors verified.

    Vectors that are null, empty, zero or not finite take no part, nor do rows without id. Only
    vectors of one length meet. Of rows that repeat in id and vector one counts; different vectors
    with one id are all indexed, and of their scores the best counts. With fewer than ``k``
    candidates all are returned. Other columns are ignored. An empty table gives an empty result.
    """
    spark = ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = materialize(map_batches(rows, _usable, "vec_id long, v binary, width int, length double").distinct(), "vectors")
    stats = good.groupBy("width").agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max("length").alias("top")).where("q > 0").collect()
    if not stats:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    limit = chi_square_point(sure, dims)
    # A bounded sample for the coarse tree, the smallest hashes of each length; every vector is indexed.
    # The known counts give a hash up to which at most a few times the sample lies, so that no task sorts more.
    upto = spark.createDataFrame([(r["width"], hash_limit(min(1.0, 2 * SAMPLE / r["n"]))) for r in stats], "width int, upto long")
    drawn = good.withColumn("h", F.xxhash64("v", "vec_id")).join(F.broadcast(upto), "width").where("h <= upto")
    first = Window.partitionBy("width").orderBy("h", "vec_id")
    sample = drawn.withColumn("r", F.row_number().over(first)).where(F.col("r") <= SAMPLE).select("width", "v").toPandas()
    known = {r["width"]: Cells(_matrix(sample.loc[sample["width"] == r["width"], "v"]), r["n"], r["top"], dims, block) for r in stats}
    shared = spark.sparkContext.broadcast(known)
    live = good.where(F.col("width").isin(list(known)))
    celled = materialize(map_batches(live.select("vec_id", "v", "width"), _celled(shared), "vec_id long, v binary, width int, cell long, low array<double>, high array<double>"), "cells")
    edges = [f(F.col(c)[d]).alias(f"{c}{d}") for c, f in (("low", F.min), ("high", F.max)) for d in range(dims)]
    sizes = celled.groupBy("width", "cell").agg(F.count("*").alias("n"), *edges).orderBy("width", "cell").toPandas()
    boxes = {}
    for width, s in sizes.groupby("width"):
        parts = -(-s["n"].to_numpy(np.int64) // block)
        boxes[int(width)] = (s["cell"].to_numpy(np.int64), parts, s[[f"low{d}" for d in range(dims)]].to_numpy(float), s[[f"high{d}" for d in range(dims)]].to_numpy(float))
    shared_boxes = spark.sparkContext.broadcast(boxes)
    many = spark.createDataFrame([(w, int(c), int(p)) for w, (cells, parts, _, _) in boxes.items() for c, p in zip(cells, parts, strict=True)], "width int, cell long, parts long")
    dealt = celled.select("vec_id", "v", "width", "cell").join(F.broadcast(many), ["width", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts"))
    # At least one vector of each part is needed for queries to find the block; with a hash all parts of a large cell have some.
    blocks = materialize(dealt.select("vec_id", "v", "width", "cell", "part").groupBy("width", "cell", "part").applyInPandas(_packed(shared), "width int, cell long, part long, block binary"), "blocks")
    asked = live.where(is_query).select(F.col("vec_id").alias("query_id"), "v", "width", F.lit(float("-inf")).alias("bound"))
    routed = "query_id long, v binary, width int, bound double, cell long, part long"
    found = materialize(_search(blocks, map_batches(asked, _routed(shared, shared_boxes, limit, True), routed), shared, k, limit), "found")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = lambda rows: rows.where("vec_id is not null").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = best(found).withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("query_id", F.col("score").alias("kth"))
    bounded = asked.drop("bound").join(kth, "query_id", "left").select("query_id", "v", "width", F.coalesce("kth", F.lit(float("-inf"))).alias("bound"))
    more = materialize(_search(blocks, map_batches(bounded, _routed(shared, shared_boxes, limit, False), routed), shared, k, limit), "found")
    every = found.unionByName(more)
    if work is not None:
        work += list(every.agg(F.sum("visited"), F.sum("verified")).first())
    discard(good, celled, blocks)
    return best(every).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
