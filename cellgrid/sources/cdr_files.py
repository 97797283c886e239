"""Daily call-detail CSV files: discovery, layout detection and one distributed scan per layout."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.fixed import ACTIVITY_COLUMNS, CELL_NAME_PART, DAILY_FILE_PATTERN, TIME_NAME_PARTS
from ..functions.scalars import to_cell, to_number

DELIMITERS = (",", ";", "\t", "|")


@dataclass(frozen=True)
class Roles:
    """Which columns of a raw file play which part."""

    cell: str
    time: str
    activities: tuple[str, ...]


def _list_files(spark: SparkSession, folder: str, pattern: str) -> list[str]:
    # The binary source has a fixed schema, so listing reads no file content.
    try:
        listing = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return []
        raise
    return sorted(listing.inputFiles())


def find_daily_files(spark: SparkSession, folder: str, pattern: str = DAILY_FILE_PATTERN) -> list[str]:
    """Paths of the daily files in name order; an error that names the folder's CSV files if there are none."""
    found = _list_files(spark, folder, pattern)
    if not found:
        others = [p.rsplit("/", 1)[-1] for p in _list_files(spark, folder, "*.csv")]
        raise FileNotFoundError(f"no file matching {pattern!r} in {folder}; CSV files there: {others}")
    return found


def sniff_delimiter(header: str) -> str:
    """The candidate that occurs most often in the header line; a comma when none does."""
    return max(DELIMITERS, key=lambda d: (header.count(d), d == ","))


def detect_roles(columns: Sequence[str], activity_names: Sequence[str] = ACTIVITY_COLUMNS) -> Roles:
    cell = next((c for c in columns if CELL_NAME_PART in c.lower()), None)
    time = next((c for c in columns if any(part in c.lower() for part in TIME_NAME_PARTS)), None)
    if cell is None or time is None:
        raise ValueError(f"no cell or time column among {list(columns)}")
    activities = tuple(n for n in activity_names if n in columns)
    if not activities:
        raise ValueError(f"none of {list(activity_names)} among {list(columns)}")
    return Roles(cell, time, activities)


_ONE_FILE_A_TASK = {"spark.sql.files.maxPartitionBytes": str(1 << 40), "spark.sql.files.openCostInBytes": str(1 << 40)}


def read_layouts(spark: SparkSession, paths: Sequence[str]) -> dict[str, list[str]]:
    """Header line -> files that have it, both in name order. One job for all files.

    Each file is one task, which stops after the first rows it is given, so no more than the first block is read.
    """
    if not paths:
        return {}

    def first(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.slice(0, 1)
                return

    before = {k: spark.conf.get(k) for k in _ONE_FILE_A_TASK}
    try:
        for k, v in _ONE_FILE_A_TASK.items():
            spark.conf.set(k, v)
        lines = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("file"), "value").mapInArrow(first, "file string, value string")
        found = lines.groupBy(F.ltrim("value", F.lit("\ufeff")).alias("header")).agg(F.sort_array(F.collect_list("file")).alias("files")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    groups = {r["header"]: r["files"] for r in found}  # names only, as the listing above
    return dict(sorted(groups.items(), key=lambda g: g[1][0]))


def read_daily_files(
    spark: SparkSession,
    folder: str,
    pattern: str = DAILY_FILE_PATTERN,
) -> tuple[DataFrame, Roles]:
    """All daily files as one frame of (cell, time, activities, ``_source_file``), plus the column roles.

    Roles come from the first file. Files may differ in delimiter and column order: each
    distinct header becomes one multi-file scan and the scans are united by name.
    Cells become long, activities double; the time column stays text until it is normalised.
    """
    paths = find_daily_files(spark, folder, pattern)
    layouts = read_layouts(spark, paths) or {"": paths}
    roles: Roles | None = None
    frames = []
    for header, files in layouts.items():
        delimiter = sniff_delimiter(header)
        columns = [c.strip() for c in next(csv.reader([header], delimiter=delimiter))]
        roles = roles or detect_roles(columns)
        schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
        raw = spark.read.schema(schema).csv(files, sep=delimiter, header=True)
        frames.append(
            raw.select(
                to_cell(roles.cell).alias(roles.cell),
                F.col(roles.time),
                *[to_number(a).alias(a) for a in roles.activities],
                F.col("_metadata.file_name").alias("_source_file"),
            )
        )
    return reduce(lambda a, b: a.unionByName(b), frames), roles
