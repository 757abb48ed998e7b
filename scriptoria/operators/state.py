"""State machines over events in order, as batch operators (ST). The streaming forms are in scriptoria.streaming.

Keys are split by user or device; within a key, order is by time and then by id, so that results are unique.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby, islice

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dealt(df: DataFrame, key: str, mixed: bool = False) -> DataFrame:
    """df with the rows of each key in one partition. mixed: df is a union of frames that may be dealt by the key already.

    Spark 4.1 then leaves out a shuffle by the same key, and joins small partitions of each frame on its own afterwards, so
    that a key's rows would lie in two places; a shuffle by a hash of the key stays.
    """
    return df.repartition(F.xxhash64(key) if mixed else F.col(key))


def in_order(df: DataFrame, key: str, order: list[str], fold: Callable[[Iterator[dict]], Iterator[dict]], schema: str, mixed: bool = False) -> DataFrame:
    """fold gets the rows of each key one by one, in order, and yields rows of the schema: a stream, however many there are. mixed: as in dealt."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    made = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches):
        rows = (r for batch in batches for r in batch.to_pylist())
        out = (x for _, held in groupby(rows, key=lambda r: r[key]) for x in fold(held))
        while part := list(islice(out, 5000)):
            yield pa.RecordBatch.from_pylist(part, schema=made)

    return dealt(df, key, mixed).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def _until_now(key: str, *order: str):
    return Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)


def schmitt(df: DataFrame, key: str, order: list[str], value: str, low: float = 70, high: float = 95) -> DataFrame:
    """Adds on: on below low, off from high on, else as before; off at first."""
    signal = F.when(F.col(value) < low, True).when(F.col(value) >= high, False)
    return df.withColumn("on", F.coalesce(F.last(signal, ignorenulls=True).over(_until_now(key, *order)), F.lit(False)))


def debounced(df: DataFrame, key: str, at: str, on: str, least: float = 0.7) -> DataFrame:
    """Switches (key, at, on) that come no sooner than so many seconds after the last accepted one.

    Whether one is accepted depends on the last accepted one, so a key's rows are taken in order.
    """

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        last = was = None
        for r in rows:
            if (was is None or was != r[on]) and (last is None or (r[at] - last[at] >= least and r[on] != last[on])):
                last = r
                yield r
            was = r[on]

    kinds = dict(df.dtypes)
    return in_order(df.select(key, at, on), key, [at, on], fold, f"{key} {kinds[key]}, {at} {kinds[at]}, {on} boolean")


def stable_runs(df: DataFrame, key: str, at: str, value: str, least: float) -> DataFrame:
    """(key, value, first, last, n): runs of one value that last so long; each fires once."""
    w = Window.partitionBy(key).orderBy(at, value)
    new = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int"), F.lit(1))
    runs = df.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(key, "_run", value).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("n")).where(F.col("last") - F.col("first") >= least).drop("_run")


def fires(df: DataFrame, key: str, at: str, value: str | None, least: float, late: float) -> DataFrame:
    """(key, first, fired): runs of one value that last so many seconds, as a stream that is late seconds behind its newest row knows them.

    A run ends with the first row of another value, without a value with the next row. One that no row ends fires if the
    newest row of all keys is far enough ahead. Nulls are a value.
    """
    ms = F.unix_millis(F.col(at).cast("timestamp"))
    rows = df.select(key, ms.alias("_ms"), (F.lit("") if value is None else F.coalesce(F.col(value).cast("string"), F.lit("\0"))).alias("_v"))
    w = Window.partitionBy(key).orderBy("_ms", "_v")
    new = F.lit(True) if value is None else ~F.col("_v").eqNullSafe(F.lag("_v").over(w))
    runs = rows.withColumn("_new", new).withColumn("_last", F.max("_ms").over(Window.partitionBy(key))).where("_new").withColumn("_next", F.lead("_ms").over(w))
    newest = rows.agg((F.max("_ms") - round(late * 1000)).alias("_mark"))  # one row
    due = F.col("_ms") + round(least * 1000)
    fired = runs.crossJoin(F.broadcast(newest)).where(F.when(F.col("_next").isNotNull(), F.col("_next") >= due).otherwise((F.col("_last") >= due) | (due < F.col("_mark"))))
    return fired.select(key, F.timestamp_millis("_ms").alias("first"), F.timestamp_millis(due).alias("fired"))


def armed_shots(values: Column, move: float = 10, still: float = 2, quiet: int = 4) -> Column:
    """Positions, from 0, at which a picture is taken: when it has been still for so many frames, once per movement.

    It is armed at first. Thresholds are our choice.
    """
    first = F.struct(F.lit(True).alias("armed"), F.lit(0).alias("calm"), F.lit(0).alias("i"), F.array().cast("array<int>").alias("shots"))

    def step(a: Column, v: Column) -> Column:
        armed = a["armed"] | (v >= move)
        calm = F.when(v < still, a["calm"] + 1).otherwise(0)
        fire = armed & (calm >= quiet)
        return F.struct((armed & ~fire).alias("armed"), calm.alias("calm"), (a["i"] + 1).alias("i"), F.when(fire, F.concat(a["shots"], F.array(a["i"]))).otherwise(a["shots"]).alias("shots"))

    return F.aggregate(values, first, step, lambda a: a["shots"])


def shots(df: DataFrame, key: str, order: list[str], value: str, move: float = 10, still: float = 2, quiet: int = 4) -> DataFrame:
    """Rows (key, *order) at which a picture is taken, by the rule of armed_shots: a key's rows pass by in order, none is held. Nulls are no movement and not still."""

    def fold(rows: Iterator[dict]) -> Iterator[dict]:
        armed, calm = True, 0
        for r in rows:
            v = r[value]
            armed, calm = armed or (v is not None and v >= move), calm + 1 if v is not None and v < still else 0
            if armed and calm >= quiet:
                armed = False
                yield r

    kinds = dict(df.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in (key, *order))
    return in_order(df.select(key, *order, value), key, order, fold, schema)


def capture_allowed(has_quad: Column, std: Column, blur: Column) -> Column:
    """Without an outline no; on plain paper yes; else if sharp."""
    return F.when(~has_quad, False).when(std < 10, True).otherwise(blur >= 60)


def failures_since_success(df: DataFrame, key: str, order: list[str], ok: Column, most: int = 5) -> DataFrame:
    """Adds failures, those since the last success, and fallback, from `most` on."""
    w = _until_now(key, *order)
    marked = df.withColumn("_ok", ok.cast("int")).withColumn("_epoch", F.sum("_ok").over(w))
    since = Window.partitionBy(key, "_epoch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return marked.withColumn("failures", F.sum(1 - F.col("_ok")).over(since)).withColumn("fallback", F.col("failures") >= most).drop("_ok", "_epoch")


def inactivity_sessions(df: DataFrame, key: str, at: str, minutes: int = 5) -> DataFrame:
    """(key, first, locks, n): activity until a pause of so many minutes, after which a lock falls."""
    s = df.groupBy(key, F.session_window(at, f"{minutes} minutes").alias("s")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("first"), F.col("s.end").alias("locks"), "n")


def queue_after_undo(df: DataFrame, key: str, order: list[str], undo: Column) -> DataFrame:
    """Jobs that are left: each undo cancels the last job before it that is not cancelled yet.

    With jobs as steps up and undos as steps down from a floor, the n-th step up to a height is cancelled by the first step
    down from it; windows tell both, so nothing is held.
    """
    w = _until_now(key, *order)
    step = F.when(undo, -1).otherwise(1)
    walked = df.select(key, *order, undo.alias("_undo"), step.alias("_step")).withColumn("_sum", F.sum("_step").over(w))
    # An undo on the floor cancels nothing: heights are counted from the lowest sum so far.
    floor = F.least(F.min("_sum").over(w), F.lit(0))
    high = walked.withColumn("_high", F.col("_sum") - floor)
    # A job at a height is left if the walk never falls below that height again.
    after = Window.partitionBy(key).orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    return high.withColumn("_low", F.min("_high").over(after)).where(~F.col("_undo") & (F.col("_low").isNull() | (F.col("_low") >= F.col("_high")))).select(key, *order)


def newest_version(df: DataFrame, key: str, version: str) -> DataFrame:
    """Of each key the row with the highest version: older results are stale."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), version).alias("x")).select(key, "x.*")


def history(df: DataFrame, key: str, order: list[Column], depth: int = 40) -> DataFrame:
    """The last so many entries of each key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= depth).drop("_r")
