"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellgrid import session
from cellgrid.session import stage_path

__all__ = ["Scratch", "claim_memory", "configure", "fresh_column", "materialise", "row_batches", "stage_path", "table", "text_or_empty"]

BATCH_ROWS = 512
_REMEMBERED: dict[str, Callable[[], None]] = {}


def claim_memory(owner: str, forget: Callable[[], None]) -> None:
    """To be called where a task uses what its worker remembers: workers outlive tasks, so what other operators remembered in them goes."""
    for other, drop in list(_REMEMBERED.items()):
        if other != owner:
            drop()
            del _REMEMBERED[other]
    _REMEMBERED[owner] = forget


def materialise(df: DataFrame, name: str = "stage", *, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and go on from the files; texts and ids are worth zstd."""
    spark = df.sparkSession
    path = path or stage_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Scratch:
    """Stage tables of one operator call that its result does not read; ``clear`` removes them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.number = spark, stage_path(spark, "scratch"), 0

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        self.number += 1
        return materialise(df, path=f"{self.folder}/{self.number:03d}-{name}")

    def clear(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def configure(spark: SparkSession) -> SparkSession:
    """The library's settings, and batches of fewer rows for Python, since rows hold whole texts."""
    session.configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fresh_column(taken: list[str], name: str) -> str:
    """``name``, with underscores added until it clashes with none of ``taken`` (names differ by more than case)."""
    used = {c.lower() for c in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def row_batches(batches, rows: int = BATCH_ROWS):
    """Arrow batches cut to ``rows`` rows, so that a task holds few long texts as Python strings at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def record_batch(columns: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    """A batch from name -> (values, type)."""
    arrays = [v if isinstance(v, pa.Array) else pa.array(v, type=t) for v, t in columns.values()]
    return pa.RecordBatch.from_arrays(arrays, names=list(columns))
