"""Connected components of a link table: union-find inside partitions, contraction between them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, map_batches, materialize


def _forest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Replace each Arrow batch of links by a spanning forest that points at the smallest node.

    Union-find works on one batch at a time, so memory is bounded by the batch and not by the
    partition; what it leaves connects the same nodes with at most one link a node.
    """
    for batch in batches:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent.setdefault(up, up)
                x = parent[x]
            return x

        for a, b in zip(batch["a"].to_numpy(), batch["b"].to_numpy(), strict=True):
            ra, rb = root(a), root(b)
            if ra != rb:
                parent[max(ra, rb)] = min(ra, rb)
        nodes = [x for x in parent if root(x) != x]
        yield pd.DataFrame({"a": nodes, "b": [root(x) for x in nodes]}, columns=["a", "b"])


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(node, root)`` with the smallest node of each component as root.

    Each round sends every node to its smallest neighbour (a pre-aggregated minimum, so a hub with
    many links is no hot group), follows one more pointer, and keeps the links between different
    roots; the rounds stop when none is left. No link leaves the executors. Nodes without a link
    are not returned; links of a node with itself and null nodes are ignored.
    """
    kind = links.schema["a"].dataType.simpleString()
    links = links.where("a <> b")
    live = materialize(map_batches(links, _forest, f"a {kind}, b {kind}").distinct(), "links")
    moves: list[DataFrame] = []
    while live.limit(1).count():
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = materialize(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("up")), "near")
        upper = near.select(F.col("node").alias("up"), F.col("up").alias("top"))
        move = materialize(near.join(upper, "up", "left").select("node", F.coalesce("top", "up").alias("up")), "moves")
        discard(near)
        moves.append(move)
        left = live.join(move.select(F.col("node").alias("a"), F.col("up").alias("ra")), "a").join(move.select(F.col("node").alias("b"), F.col("up").alias("rb")), "b")
        rest = materialize(left.where("ra <> rb").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "links")
        discard(live)
        live = rest
    if not moves:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = moves[-1].select("node", F.col("up").alias("root"))
    for move in reversed(moves[:-1]):
        later = found.select(F.col("node").alias("up"), "root")
        found = move.join(later, "up", "left").select("node", F.coalesce("root", "up").alias("root"))
    return found
