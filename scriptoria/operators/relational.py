"""Filters, sorts, updates and access rules over catalogue tables (REL, JOIN-9, JOIN-10)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search(df: DataFrame, needle: str, *columns: str) -> DataFrame:
    """Rows whose columns, joined by blanks, contain the needle in any case. Null columns are empty."""
    whole = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    return df.where(F.contains(F.lower(whole), F.lower(F.lit(needle))))


def first_then_newest(df: DataFrame, first: Column, at: Column) -> DataFrame:
    """Rows that are first, then by time, newest first; rows without a time come last."""
    return df.orderBy(F.when(first, 0).otherwise(1), F.coalesce(at, F.lit("1970-01-01").cast("timestamp")).desc())


def counts_if(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition, in one pass."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def update_where_in(df: DataFrame, ids: DataFrame, key: str, **values: Column) -> DataFrame:
    """df with the columns changed in rows whose key is among the ids."""
    marked = df.join(ids.select(F.col(key)).distinct().withColumn("_hit", F.lit(True)), key, "left")
    return marked.select(*[F.when(F.col("_hit"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in df.columns])


def insert_new(df: DataFrame, more: DataFrame, key: str) -> DataFrame:
    """df and those rows of more whose key it lacks; of equal keys in more, rows stay as they are."""
    return df.unionByName(more.join(df.select(key), key, "left_anti"))


def upsert(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """df with the rows of changes in place of those with the same key."""
    return df.join(changes.select(key), key, "left_anti").unionByName(changes)


def delete_cascade(parent: DataFrame, child: DataFrame, ids: DataFrame, key: str, foreign: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the ids and what refers to them."""
    return parent.join(ids, key, "left_anti"), child.join(ids.withColumnRenamed(key, foreign), foreign, "left_anti")


def set_null_where_gone(child: DataFrame, parent: DataFrame, foreign: str, key: str) -> DataFrame:
    """References to rows that no longer exist become null."""
    there = parent.select(F.col(key).alias("_key")).distinct()
    joined = child.join(there, F.col(foreign) == F.col("_key"), "left")
    return joined.select(*[F.col("_key").alias(c) if c == foreign else F.col(c) for c in child.columns])


def visible(rows: DataFrame, me: Column, owner: str, is_admin: Column) -> DataFrame:
    """Own rows, or all for admins."""
    return rows.where((F.col(owner) == me) | is_admin)


def outside_locked(rows: DataFrame, locked: DataFrame, folder: str, everything: bool = False) -> DataFrame:
    """Rows outside locked folders; with everything, as a backup needs it, all rows."""
    return rows if everything else rows.join(locked.select(folder), folder, "left_anti")


def first_arrival(df: DataFrame, order: list[Column]) -> DataFrame:
    """The first row of all gets role admin and status active, others user and pending.

    The first is found by an aggregate, so that no task sees all rows.
    """
    first = df.agg(F.min(F.struct(*order)).alias("_first"))
    joined = df.crossJoin(F.broadcast(first))  # one row
    hit = F.struct(*order) == F.col("_first")
    return joined.withColumn("role", F.when(hit, "admin").otherwise("user")).withColumn("status", F.when(hit, "active").otherwise("pending")).drop("_first")


def redeem_outcome(token: Column, used: Column, expires: Column, invited: Column, mail: Column, now: Column) -> Column:
    """Why an invitation cannot be redeemed, or ok; checked in this order."""
    return (
        F.when(token.isNull(), "missing")
        .when(used.isNotNull(), "used")
        .when(expires < now, "expired")
        .when(invited.isNotNull() & (F.lower(invited) != F.lower(mail)), "other person")
        .otherwise("ok")
    )


def with_column_if_absent(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df if name in df.columns else df.withColumn(name, value)


def renewed(index: DataFrame, sources: DataFrame, key: str, version: str, build: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index after a change of versions: entries of sources with the same version stay, sources with another one are built anew, those that are gone leave.

    Index entries carry key and version. build makes entries of sources. A source without a version is always built anew.
    """
    kept = index.join(sources.select(key, version), [key, version], "left_semi")
    changed = sources.join(index.select(key, version).distinct(), [key, version], "left_anti")
    return kept.unionByName(build(changed).select(*index.columns))


def latest(df: DataFrame, n: int, *order: Column) -> DataFrame:
    return df.orderBy(*order).limit(n)


def shares(df: DataFrame, category: str, amount: str) -> DataFrame:
    """Sum by category and its share of the whole."""
    sums = df.groupBy(category).agg(F.sum(amount).alias("amount"))
    return sums.withColumn("share", F.col("amount") / F.sum("amount").over(Window.partitionBy()))
