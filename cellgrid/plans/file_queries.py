"""Queries that write a table's rows as files, read them back through the sources, and are compared as any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import scalars
from ..functions.fixed import ACTIVITY_COLUMNS, DAILY_FILE_PATTERN, ROUTINE
from ..operators import collapse, serving
from ..session import materialise, stage_path
from ..sources.cdr_files import read_daily_files
from ..sources.report_store import ReportStore
from ..sources.serving_store import ServingStore
from ..sources.tables import load_calendar, load_table, normalise_time, write_table
from . import event_panel as ep
from .queries import KEY, _rounded, _serving, query


def _write_days(raw: DataFrame, folder: str, **options: str) -> None:
    """One CSV file a day of ``raw``, named as a daily file. Days are few; each is written by one task."""
    spark = raw.sparkSession
    parts = stage_path(spark, "day-parts")
    raw.repartition("day").write.partitionBy("day").options(header=True, **options).csv(parts)
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(folder))
    for day in files.globStatus(path(f"{parts}/day=*")):
        name = DAILY_FILE_PATTERN.replace("*", day.getPath().getName().removeprefix("day="))
        for part in files.globStatus(path(f"{day.getPath()}/part-*.csv")):
            files.rename(part.getPath(), path(f"{folder}/{name}"))


def _daily_folder(spark: SparkSession, folder: str) -> str:
    """Three layouts: workdays with commas, Saturdays with tabs and columns reversed, Sundays with epoch times and bars."""
    raw = materialise(ep.raw_activity(spark, folder).withColumn("day", F.col("_source_file")).drop("_source_file"), "raw")
    target = stage_path(spark, "daily")
    weekday = F.weekday("datetime")
    _write_days(raw.filter(weekday < 5), target)
    _write_days(raw.filter(weekday == 5).select(*reversed(raw.columns)), target, sep="\t")
    epoch = F.unix_millis(F.col("datetime").cast("timestamp"))
    _write_days(raw.filter(weekday == 6).withColumn("datetime", epoch), target, sep="|")
    return target


@query
def daily_files_read(spark, folder):
    """Discovery, delimiters, roles, coercion, lineage and time normalisation over files of three layouts."""
    raw, roles = read_daily_files(spark, _daily_folder(spark, folder))
    raw = raw.withColumnsRenamed({roles.cell: "CellID", roles.time: "datetime"})
    collapsed = collapse.collapse_country_codes(raw, activities=roles.activities)
    return normalise_time(collapsed, "datetime").select(*KEY, "_source_file", *ACTIVITY_COLUMNS)


@query
def daily_files_rejected(spark, folder):
    """Raw and rejected rows of every file, after every seventh row's cell was spoilt."""
    raw = ep.raw_activity(spark, folder)
    text = F.col("CellID").cast("string")
    spoilt = F.when(F.col("countrycode") % 7 == 0, F.concat(text, F.lit(".5"))).when(F.col("countrycode") % 7 == 1, F.lit("nan"))
    cells = raw.withColumn("CellID", scalars.to_cell(F.coalesce(spoilt, text)))
    rejected = collapse.rejected_rows(cells).join(cells.groupBy("_source_file").agg(F.count(F.lit(1)).alias("raw_rows")), "_source_file")
    return rejected.select("_source_file", "raw_rows", "without_cell", "without_time")


@query
def stage_tables_read(spark, folder):
    """Users' totals written as Parquet and as CSV, each loaded by name without its suffix."""
    events = spark.read.parquet(f"{folder}/events.parquet")
    totals = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100)).alias("cents"))
    totals = materialise(totals, "totals")
    loaded = []
    for fmt in ("parquet", "csv"):
        base = stage_path(spark, "table")
        write_table(totals, base, fmt=fmt)
        loaded.append(load_table(spark, base, schema=totals.schema).withColumn("format", F.lit(fmt)))
    return loaded[0].unionByName(loaded[1])


@query
def calendar_read(spark, folder):
    events = spark.read.parquet(f"{folder}/events.parquet")
    base = stage_path(spark, "calendar")
    days = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("date")).agg(F.count(F.lit(1)).alias("n"))
    write_table(days, base, fmt="csv")
    loaded = load_calendar(spark, f"{base}.csv")
    return loaded.select(F.date_add("date", 1).cast("string").alias("next_day"), F.col("n").cast("long").alias("n"))


@query
def serving_store_read(spark, folder):
    """The case table after two full reloads of the serving store."""
    tables = _serving(spark, folder)
    store = ServingStore(spark, stage_path(spark, "store"))
    for _ in range(2):
        store.reload(tables)
    return store.read("cases").withColumns({c: _rounded(c, 3) for c in ("deficit", "covered")})


@query
def report_store_upsert(spark, folder):
    """The report table in buckets: reports of the routine cases, then those of all cases."""
    tables = _serving(spark, folder)
    store = ReportStore(spark, stage_path(spark, "report-store"), buckets=8)
    for cases, day in ((tables["cases"].filter(F.col("classification") == ROUTINE), "2024-02-01"), (tables["cases"], "2024-03-01")):
        texts = serving.generate_reports(cases, tables["sources"])
        store.upsert(texts, now=F.lit(f"{day} 00:00:00").cast("timestamp_ntz"))
    return store.read()
