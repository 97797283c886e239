"""Daily files as a stream: each arriving file is collapsed once and lands in its own partition."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.fixed import DAILY_FILE_PATTERN
from ..functions.scalars import to_cell, to_number
from ..operators.collapse import SOURCE, collapse_country_codes
from ..sources.cdr_files import Roles, detect_roles, find_daily_files, read_layouts, sniff_delimiter
from ..sources.tables import normalise_time


def stream_daily_files(
    spark: SparkSession, folder: str, pattern: str = DAILY_FILE_PATTERN, *, files_per_batch: int = 16
) -> tuple[DataFrame, Roles]:
    """Streaming counterpart of the batch scan. The layout comes from the first file present;
    a later file with other columns fails the stream instead of being misread."""
    header = next(iter(read_layouts(spark, find_daily_files(spark, folder, pattern)[:1])))
    delimiter = sniff_delimiter(header)
    columns = [c.strip() for c in next(csv.reader([header], delimiter=delimiter))]
    roles = detect_roles(columns)
    raw = (
        spark.readStream.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns]))
        .option("sep", delimiter).option("header", True).option("enforceSchema", False)
        .option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch)
        .csv(folder)
    )
    selected = raw.select(
        to_cell(roles.cell).alias("CellID"),
        F.col(roles.time).alias("datetime"),
        *[to_number(a).alias(a) for a in roles.activities],
        F.col("_metadata.file_name").alias(SOURCE),
    )
    return selected, roles


def write_collapsed(
    stream: DataFrame, roles: Roles, out: str, checkpoint: str, *, tz: str | None = None, **trigger
) -> StreamingQuery:
    """Collapse every micro-batch and overwrite the partitions of its files.

    A micro-batch holds whole files, so its sums per (cell, time, file) are complete and need no
    state; a batch that is replayed after a failure overwrites the same partitions.
    """

    def save(batch: DataFrame, _: int) -> None:
        collapsed = collapse_country_codes(batch, activities=roles.activities)
        (
            normalise_time(collapsed, "datetime", tz=tz)
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy(SOURCE).parquet(out)
        )

    return (
        stream.writeStream.foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
