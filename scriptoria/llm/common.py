"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed by the operators' contracts: white space is U+0020 and U+0009 to U+000D, words are what lies between.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shared_folder(sc: SparkContext) -> str:
    """The shared folder of ``spark.checkpoint.dir``.

    A folder of our own is set only where the session names none and all runs on one machine; on a cluster that fails.
    """
    if sc.getCheckpointDir() is None:
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="scriptoria-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as its partitions are."""
    _shared_folder(df.sparkSession.sparkContext)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: compressed, and read by columns. Its partitions may be others."""
    path = f"{_shared_folder(df.sparkSession.sparkContext)}/{uuid.uuid4()}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_or_shuffled(df: DataFrame, rows: int) -> DataFrame:
    """df for a join: sent to all tasks if it has been counted to have no more than so many rows, else joined by shuffling."""
    return F.broadcast(df) if df.count() <= rows else df


def record(**fields: Column) -> Column:
    """A struct by names; inside nested lambdas F.struct loses those of aliases."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def crc32_of(column: str) -> F.Column:
    """crc32 of a column's text, as the contracts' fold numbers need it."""
    return F.crc32(F.col(column).cast("string").cast("binary"))


def words_of(text: str | None, lower: bool = False) -> list[bytes]:
    """Words as UTF-8. bytes.split() splits at exactly the contract's white space; bytes.lower() lowers A-Z only."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return (data.lower() if lower else data).split()


def map_rows(df: DataFrame, columns: list[str], schema: str, per_batch: Callable[..., dict]) -> DataFrame:
    """per_batch gets the columns' Python lists of each Arrow batch and returns the output columns by name."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    out = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                made = per_batch(*(c.to_pylist() for c in part.columns))
                yield pa.RecordBatch.from_arrays([pa.array(made[f.name], f.type) for f in out], schema=out)

    return df.select(*columns).mapInArrow(run, schema)
