"""Queries by name, with the operators that each shows and its SQL for a second engine."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    ops: tuple[str, ...]
    oracle: str | None


REGISTRY: dict[str, Query] = {}


def query(name: str, ops: str, oracle: str | None = None):
    """Register ``run(spark, sf_dir)``; ``ops`` are operator ids of the survey."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"{name} is registered twice")
        REGISTRY[name] = Query(run, tuple(ops.split()), oracle)
        return run

    return add
