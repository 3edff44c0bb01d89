"""Whitening of embeddings by hierarchical merging of singular value decompositions (Iwen and Ong, 2016).

Every task decomposes runs of centred rows and keeps all singular values, right vectors, the count and
the exact sums. Two such parts are merged by stacking their scaled vectors and one row that corrects
for the difference of their means, and decomposing again: nothing is cut off, so the outcome is that
of one decomposition of all rows, whatever the partitions. Parts are merged in rounds of small groups.
Then models and rows stream together, each model before the rows of its length.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import discard, look_up, map_batches, materialize

#: Whole numbers are floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Components that come back.
COMPONENTS = 16
#: Entries of this size and more have no exact whole number here and count as not finite.
LARGEST = float(2**40)
#: Parts that are merged in one go, rows that one copy of a model serves, and numbers that a task keeps in parts.
FAN, ROWS_A_PART, HELD_NUMBERS = 8, 2_000, 4 << 20
#: A variance below this share of the largest one is none: double precision does not tell it from zero.
NOTHING = 1e-13


class Part:
    """Count, exact sums, singular values and right vectors of some centred rows; all of them, no rank is cut."""

    def __init__(self, n: int, sums: list[int], values: np.ndarray, axes: np.ndarray):
        self.n, self.sums, self.values, self.axes = n, sums, values, axes

    @classmethod
    def of(cls, rows: np.ndarray) -> Part:
        n = len(rows)
        sums = [int(s) for s in rows.astype(object).sum(axis=0)] if np.abs(rows).max(initial=0) > 2**62 // n else rows.sum(axis=0).tolist()
        return cls(n, sums, *decomposed(centred(rows, n, sums)))

    def merged(self, other: Part) -> Part:
        n = self.n + other.n
        # Whole numbers up to the one division, so that large equal means leave no rounding error.
        gap = np.array([(a * other.n - b * self.n) / (self.n * other.n) for a, b in zip(self.sums, other.sums, strict=True)])
        stacked = np.concatenate([self.values[:, None] * self.axes, other.values[:, None] * other.axes, math.sqrt(self.n * other.n / n) * gap[None, :]])
        return Part(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], *decomposed(stacked))


def decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, axes = np.linalg.svd(rows, full_matrices=False)
    return values, axes


def departures(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """``n * row - sums``, exact: 64-bit numbers where they suffice, else Python's."""
    top = max(int(np.abs(rows).max(initial=0)) * n, max(map(abs, sums), default=0))
    if top < 2**62:
        return rows * n - np.array(sums, np.int64)
    return rows.astype(object) * n - np.array(sums, object)


def centred(rows: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return departures(rows, n, sums).astype(float) / n


def fold(parts: list[Part]) -> Part:
    """Merge pairwise, as a tree."""
    while len(parts) > 1:
        parts = [parts[i].merged(parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


class Model:
    """Mean, variances and components of one vector length."""

    def __init__(self, part: Part, components: int):
        self.n, self.sums = part.n, part.sums
        variance = part.values**2 / part.n
        self.trace = float(variance.sum())
        k = min(components, len(part.sums))
        # Fewer rows than entries: what is missing has no variance.
        self.variance = np.concatenate([variance, np.zeros(max(0, k - len(variance)))])[:k]
        axes = np.concatenate([part.axes, np.zeros((max(0, k - len(variance)), len(part.sums)))])[:k]
        self.live = self.variance > NOTHING * max(self.variance.max(initial=0.0), 1e-300)
        # Of both signs the one with a positive largest entry.
        at = np.abs(axes).argmax(axis=1)
        self.axes = axes * np.where(axes[np.arange(k), at] < 0, -1.0, 1.0)[:, None]
        self.error: float | None = None

    def whitened(self, rows: np.ndarray) -> np.ndarray:
        """Projections over the square roots of the variances; not a number for components without variance."""
        scale = np.where(self.live, np.sqrt(np.where(self.live, self.variance, 1.0)), np.nan)
        return centred(rows, self.n, self.sums) @ self.axes.T / scale

    def deviations(self, rows: np.ndarray) -> list[int | None]:
        """Exact sums of squared departures; None beyond 64 bits."""
        gap = departures(rows, self.n, self.sums)
        if gap.dtype == object or int(np.abs(gap).max(initial=0)) ** 2 * rows.shape[1] >= 2**63:
            return [s if s < 2**63 else None for s in (sum(int(g) ** 2 for g in row) for row in gap)]
        return (gap * gap).sum(axis=1).tolist()


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.int64)


def _decomposed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows ``(width, y)`` to parts; several a length where a task meets many lengths."""
    parts: dict[int, Part] = {}

    def out() -> pd.DataFrame:
        return pd.DataFrame({"width": list(parts), "part": [pickle.dumps(p, protocol=5) for p in parts.values()]}, columns=["width", "part"])

    for batch in batches:
        for width, rows in batch.groupby("width", sort=False):
            new = Part.of(_matrix(rows["y"]))
            parts[width] = parts[width].merged(new) if width in parts else new
        if sum(w * w for w in parts) > HELD_NUMBERS:
            yield out()
            parts.clear()
    yield out()


def _folded(group: pd.DataFrame) -> pd.DataFrame:
    return group[["width"]].head(1).assign(part=pickle.dumps(fold([pickle.loads(p) for p in sorted(group["part"])]), protocol=5))


def decomposition(fit: DataFrame) -> DataFrame:
    """``fit(width, y)`` to one row ``(width, part)`` for each length."""
    parts = materialize(map_batches(fit, _decomposed, "width int, part binary"), "parts")
    while (most := parts.groupBy("width").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1:
        groups = parts.groupBy("width").agg(F.ceil(F.count("*") / FAN).alias("groups"))
        dealt = parts.join(groups, "width").withColumn("group", F.pmod(F.xxhash64("part", F.lit(most)), "groups"))
        merged = materialize(dealt.groupBy("width", "group").applyInPandas(_folded, "width int, part binary"), "parts")
        discard(parts)
        parts = merged
    return parts


def _modelled(components: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            models = [Model(pickle.loads(p), components) for p in batch["part"]]
            yield batch[["width"]].assign(model=[pickle.dumps(m, protocol=5) for m in models])

    return run


def _streamed(answer):
    """``answer`` over runs of rows, with the model of their length, which comes before them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, key = None, None
        for batch in batches:
            for now, rows in batch.groupby(["width", "salt"], sort=False):
                held = rows["model"].notna()
                if held.any():
                    model, key = pickle.loads(rows.loc[held, "model"].iloc[0]), now
                if held.all():
                    continue
                if key != now:
                    raise ValueError(f"no model {now} for its rows")
                yield answer(model, rows[~held], now[0])

    return run


def _beside(rows: DataFrame, models: DataFrame) -> DataFrame:
    """``rows(width, vec_id, y, at)`` and ``models(width, model)`` in one stream: by length and salt of ``at``, the model first."""
    sizes = rows.groupBy("width").agg(F.count("*").alias("members")).withColumn("salts", F.ceil(F.col("members") / ROWS_A_PART).cast("int"))
    sizes = materialize(sizes, "sizes")
    total, parts = (x or 0 for x in sizes.agg(F.sum("members"), F.sum("salts")).first())
    salted = look_up(rows, sizes, "width", total).withColumn("salt", F.pmod(F.xxhash64("at"), "salts").cast("int"))
    empty = lambda kind: F.lit(None).cast(kind)
    stay = models.join(sizes, "width").select("width", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("turn"), "model", empty("long").alias("vec_id"), empty("array<bigint>").alias("y"))
    move = salted.select("width", "salt", F.lit(1).alias("turn"), empty("binary").alias("model"), "vec_id", "y")
    return stay.unionByName(move).repartition(max(1, int(parts)), "width", "salt").sortWithinPartitions("width", "salt", "turn").drop("turn")


def _products(model: Model, rows: pd.DataFrame, width: int) -> pd.DataFrame:
    w = model.whitened(_matrix(rows["y"]))
    return pd.DataFrame({"width": [width], "sums": [w.sum(axis=0)], "products": [(w.T @ w).reshape(-1)]})


def _checked(model: Model, rows: pd.DataFrame) -> float | None:
    """The largest entry of the whitened covariance less the identity, over the components that have variance."""
    live = model.live
    if not live.any():
        return None
    mean = rows["sums"].sum() / model.n
    covariance = rows["products"].sum().reshape(len(live), len(live)) / model.n - np.outer(mean, mean)
    return float(np.abs(covariance - np.eye(len(live)))[np.ix_(live, live)].max())


def _with_error(group: pd.DataFrame) -> pd.DataFrame:
    model = pickle.loads(group["model"].dropna().iloc[0])
    model.error = _checked(model, group[group["model"].isna()])
    return pd.DataFrame({"width": group["width"].iloc[:1], "model": [pickle.dumps(model, protocol=5)]})


def _answered(model: Model, rows: pd.DataFrame, width: int) -> pd.DataFrame:
    y = _matrix(rows["y"])
    w, k = model.whitened(y), len(model.variance)
    share = model.variance / model.trace if model.trace else np.full(k, np.nan)
    none = lambda v: np.where(np.isnan(v), None, v)
    return pd.DataFrame(
        {
            "vec_id": np.repeat(rows["vec_id"].to_numpy(), k),
            "component": np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows)),
            "n": model.n,
            "deviation": np.repeat(np.array(model.deviations(y), object), k),
            "whitened": none(w.reshape(-1)),
            "explained": none(np.tile(share, len(rows))),
            "identity_error": [model.error] * (k * len(rows)),
        }
    )


def whitened(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``vectors(vec_id, embedding)`` to ``(vec_id, component, n, deviation, whitened, explained, identity_error)``.

    One row for each vector and each of the first ``components`` components, or as many as it has
    entries. Entries become whole numbers x; the components, variances and the mean are those of
    the distinct x vectors, ``n`` in number. ``deviation`` is the sum of ``(n * x - S) ** 2``, exact,
    null beyond 64 bits; ``whitened`` the projection of ``x - S / n`` over the root of the
    variance; ``explained`` the variance's share of all; ``identity_error`` the largest entry by
    which the covariance of ``whitened`` over the distinct vectors differs from the identity.

    Vectors that are null or empty, or hold a null, a value that is not finite or one of 2 ** 40
    or more in size, are left out. Vectors of different length are spaces of their own. A
    component without variance has a null ``whitened`` and takes no part in ``identity_error``,
    which is null if there is no other. Rows that repeat, or lack an id, come back as they are. Of
    equal variances the decomposition's order holds. Other columns are ignored; an empty table
    gives an empty result.
    """
    ship(vectors.sparkSession)
    entries = F.transform(F.col("embedding").cast("array<double>"), lambda c: F.when(F.abs(c) < LARGEST, F.floor(c * SCALE)))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), entries.alias("y")).where("y is not null and size(y) > 0").where(~F.exists("y", lambda c: c.isNull()))
    # A number of its own for each row, written down, deals rows that repeat over many tasks.
    rows = materialize(rows.select("vec_id", "y", F.size("y").alias("width"), F.monotonically_increasing_id().alias("at")), "rows")
    fit = materialize(rows.select("width", "y").distinct(), "fit")
    parts = decomposition(fit)
    models = materialize(map_batches(parts, _modelled(components), "width int, model binary"), "models")
    partial = "width int, sums array<double>, products array<double>"
    products = map_batches(_beside(fit.select("width", "y", F.lit(None).cast("long").alias("vec_id"), F.xxhash64("y").alias("at")), models), _streamed(_products), partial)
    # One row a task and length comes out; they meet by position, so that no task gets those of all.
    flat = products.select("width", F.posexplode(F.concat("sums", "products")).alias("at", "v")).groupBy("width", "at").agg(F.sum("v").alias("v"))
    sums = flat.groupBy("width").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("all"))
    k = F.least(F.col("width"), F.lit(components))
    sums = sums.select("width", F.lit(None).cast("binary").alias("model"), F.slice("all", F.lit(1), k).alias("sums"), F.slice("all", k + 1, k * k).alias("products"))
    empty = F.lit(None).cast("array<double>")
    told = models.select("width", "model", empty.alias("sums"), empty.alias("products")).unionByName(sums)
    checked = materialize(told.groupBy("width").applyInPandas(_with_error, "width int, model binary"), "checked")
    out = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return map_batches(_beside(rows, checked), _streamed(_answered), out)
