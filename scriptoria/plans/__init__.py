"""Queries over the tables, each with its SQL twin where SQL can express it."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir; one of our own only where all runs on one machine."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scriptoria-"))
    return f"{sc.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def rows(spark: SparkSession, schema: str, values: list[tuple[Any, ...]]) -> DataFrame:
    """A small relation written out in the query."""
    return spark.createDataFrame(values, schema)


def as_sql(names: str, values: list[tuple[Any, ...]]) -> str:
    """The same relation for SQL: (VALUES ...) AS v(names)."""

    def literal(x: Any) -> str:
        if x is None:
            return "NULL"
        if isinstance(x, bool):
            return str(x).upper()
        if isinstance(x, int):
            return str(x)
        if isinstance(x, float):
            return f"{x!r}::DOUBLE"
        if isinstance(x, list):
            return "[" + ", ".join(map(literal, x)) + "]"
        return "'" + str(x).replace("'", "''") + "'"

    return "(VALUES " + ", ".join("(" + ", ".join(map(literal, v)) + ")" for v in values) + f") AS v({names})"
