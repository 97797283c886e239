"""Stage tables on shared storage: load, timestamp normalisation, calendar, write."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def _read_or_none(reader, path: str) -> DataFrame | None:
    try:
        return reader(path)
    except AnalysisException as err:
        if "PATH_NOT_FOUND" in str(err):
            return None
        raise


def load_table(spark: SparkSession, base: str, *, required: bool = True, schema=None) -> DataFrame | None:
    """``base.parquet`` if it exists, else ``base.csv``; else an error, or None when not required.

    Pass ``schema`` for large CSV tables: without it Spark reads them once more to infer types.
    """
    found = _read_or_none(spark.read.parquet, base + ".parquet")
    if found is not None:
        return found

    def read_csv(path: str) -> DataFrame:
        reader = spark.read.schema(schema) if schema is not None else spark.read.option("inferSchema", True)
        return reader.csv(path, header=True)

    found = _read_or_none(read_csv, base + ".csv")
    if found is None and required:
        raise FileNotFoundError(f"neither {base}.parquet nor {base}.csv exists")
    return found


def _parse_text(text: Column, tz: str | None) -> Column:
    epoch = text.try_cast("bigint")
    return F.coalesce(_from_epoch_ms(epoch, tz), text.try_cast("timestamp_ntz"))


def _from_epoch_ms(ms: Column, tz: str | None) -> Column:
    utc = F.timestamp_millis(ms)
    return (F.from_utc_timestamp(utc, tz) if tz else utc).cast("timestamp_ntz")


def normalise_time(
    df: DataFrame, column: str = "datetime", *, on_bad: str = "raise", tz: str | None = None
) -> DataFrame:
    """Turn ``column`` into a zone-free timestamp.

    Numbers, and text that holds an integer, are epoch milliseconds in UTC (``tz`` moves them
    to a local clock); other text is parsed. Unreadable text becomes NULL or raises.
    """
    if on_bad not in ("raise", "null"):
        raise ValueError("on_bad is 'raise' or 'null'")
    kind = df.schema[column].dataType
    c = F.col(column)
    if isinstance(kind, T.TimestampNTZType):
        return df
    if isinstance(kind, (T.TimestampType, T.DateType)):
        return df.withColumn(column, c.cast("timestamp_ntz"))
    if isinstance(kind, T.NumericType):
        return df.withColumn(column, _from_epoch_ms(c.cast("bigint"), tz))
    parsed = _parse_text(F.trim(c), tz)
    if on_bad == "raise":
        message = F.concat(F.lit(f"unreadable time in {column}: "), c)
        parsed = F.when(c.isNotNull() & parsed.isNull(), F.raise_error(message).cast("timestamp_ntz")).otherwise(parsed)
    return df.withColumn(column, parsed)


def load_calendar(spark: SparkSession, path: str, date_column: str = "date") -> DataFrame:
    """Calendar from Parquet (by suffix) or CSV; ``date_column``, where present, becomes a date."""
    if path.lower().endswith(".parquet"):
        frame = spark.read.parquet(path)
    else:
        frame = spark.read.csv(path, header=True, inferSchema=True)
    if date_column in frame.columns:
        frame = frame.withColumn(date_column, F.col(date_column).cast("timestamp_ntz").cast("date"))
    return frame


def write_table(df: DataFrame, base: str, *, fmt: str = "parquet", partition_by: tuple[str, ...] = ()) -> str:
    """Overwrite ``base.parquet`` (or ``base.csv``) and return its path."""
    path = f"{base}.{fmt}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "parquet":
        writer.parquet(path)
    elif fmt == "csv":
        writer.csv(path, header=True)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    return path


def stage(df: DataFrame, base: str, **kwargs) -> DataFrame:
    """Write a stage table and read it back, so that later stages start from stored data."""
    path = write_table(df, base, **kwargs)
    spark = df.sparkSession
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    return spark.read.schema(df.schema).csv(path, header=True)
