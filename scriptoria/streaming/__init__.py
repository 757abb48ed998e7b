"""Streaming forms of the state machines: same answers as the batch ones, from a stream in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def schmitt(stream: DataFrame, key: str, at: str, value: str, low: float = 70, high: float = 95, least: float = 0.0) -> DataFrame:
    """(key, at, value, on): on below low, off from high on; switches sooner than least seconds after the last are ignored."""
    kinds = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        on, last = state.get if state.exists else (False, float("-inf"))
        for frame in frames:
            frame = frame.sort_values(at)
            out = []
            for t, v in zip(frame[at], frame[value], strict=True):
                want = True if v < low else False if v >= high else on
                if want != on and t - last >= least:
                    on, last = want, float(t)
                out.append(on)
            yield pd.DataFrame({key: k[0], at: frame[at].to_numpy(), value: frame[value].to_numpy(), "on": out})
        state.update((on, last))

    schema = f"{key} {kinds[key]}, {at} {kinds[at]}, {value} {kinds[value]}, on boolean"
    return stream.select(key, at, value).groupBy(key).applyInPandasWithState(run, schema, "on boolean, last double", "append", GroupStateTimeout.NoTimeout)


def armed_shots(stream: DataFrame, key: str, at: str, value: str, move: float = 10, still: float = 2, quiet: int = 4) -> DataFrame:
    """(key, at) of each picture taken: still for so many frames, once per movement; armed at first."""
    kinds = dict(stream.dtypes)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, calm = state.get if state.exists else (True, 0)
        for frame in frames:
            shots = []
            for t, v in frame.sort_values(at)[[at, value]].itertuples(index=False):
                armed, calm = armed or v >= move, calm + 1 if v < still else 0
                if armed and calm >= quiet:
                    shots.append(t)
                    armed = False
            yield pd.DataFrame({key: [k[0]] * len(shots), at: shots})
        state.update((armed, calm))

    return stream.select(key, at, value).groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, {at} {kinds[at]}", "armed boolean, calm int", "append", GroupStateTimeout.NoTimeout)


def sessions(stream: DataFrame, key: str, at: str, minutes: int = 5, late: str = "10 minutes") -> DataFrame:
    """(key, first, locks, n) of each session, once no more late events can come."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    s = timed.groupBy(key, F.session_window(at, f"{minutes} minutes").alias("s")).agg(F.count("*").alias("n"))
    return s.select(key, F.col("s.start").alias("first"), F.col("s.end").alias("locks"), "n")


def tumbling_counts(stream: DataFrame, at: str, by: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, by, n, value): counts per window and kind (an extension)."""
    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return timed.groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), by, "n", "value")


def fires(stream: DataFrame, key: str, at: str, value: str | None, least: float, late: str = "10 minutes") -> DataFrame:
    """(key, first, fired) once a value has stayed the same for so many seconds of event time, also if no row comes any more.

    first is the run's first row; a change arms again. Without a value every row does, so that silence is what fires: a lock
    after inactivity. Timers follow the watermark, which is late behind the newest row of any key; rows that come later than
    that are dropped. Within a trigger rows are put in order. The batch form is state.fires.
    """
    kinds = dict(stream.dtypes)
    pause = round(least * 1000)

    def run(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        was, first, done = state.get if state.exists else (None, None, True)
        out = []
        if not state.hasTimedOut:
            rows = pd.concat(list(frames)).sort_values(["_ms", "_v"], kind="stable")
            for ms, v in zip(rows["_ms"].tolist(), rows["_v"].tolist(), strict=True):
                if not done and ms - first >= pause:
                    out.append(first)
                    done = True
                if first is None or value is None or v != was:
                    was, first, done = v, ms, False
        elif not done:
            out.append(first)
            done = True
        state.update((was, first, done))
        # A timer that the watermark has passed already is set right behind it.
        if not done:
            state.setTimeoutTimestamp(max(first + pause, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [k[0]] * len(out), "_first": out})

    timed = stream.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    given = timed.select(key, at, F.unix_millis(at).alias("_ms"), (F.lit("") if value is None else F.coalesce(F.col(value).cast("string"), F.lit("\0"))).alias("_v"))
    fired = given.groupBy(key).applyInPandasWithState(run, f"{key} {kinds[key]}, _first long", "was string, first long, done boolean", "append", GroupStateTimeout.EventTimeTimeout)
    return fired.select(key, F.timestamp_millis("_first").alias("first"), F.timestamp_millis(F.col("_first") + pause).alias("fired"))


def run_to_files(stream: DataFrame, path: str, checkpoint: str) -> None:
    """All that is there now, and what timers give after it, as Parquet files in path."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()


def shared_files(spark: SparkSession, folder: str, schema: str, each_time: int = 10) -> DataFrame:
    """Files dropped into a folder, a few per trigger, deleted once they are taken in."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", each_time).option("cleanSource", "delete").json(folder)


def import_files(files: DataFrame, target: str, checkpoint: str) -> None:
    """Takes in all files that are there: each batch once, also if it is tried again after a failure.

    A batch is written into a folder by its number, in the place of an earlier try; the stream's checkpoint is the ledger of
    what each number held. Dropped files are deleted by the source only after their batch is committed.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={number}")

    files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
