"""The report table in buckets of its key: an upsert writes the buckets it touches and leaves all other files as they are."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators.reports import upsert_reports
from ..operators.serving import REPORTS_SCHEMA, empty_reports
from ..session import materialise
from .manifest import ManifestLog

BUCKETS = 64


class ReportStore:
    """Reports (id, case_id, report_text, generated_at) by hash buckets of ``case_id`` below ``base``.

    The manifest names each bucket's folder and the last id given out. Readers of an older manifest keep
    its folders; of two writers at once, one fails with FileExistsError and can start again.
    """

    def __init__(self, spark: SparkSession, base: str, *, buckets: int = BUCKETS):
        self.spark, self.base = spark, base.rstrip("/")
        self.log = ManifestLog(spark, f"{self.base}/_manifests")
        latest = self.log.latest()
        self.buckets = latest[1]["buckets"] if latest else buckets

    def _bucket(self, case_id: str = "case_id") -> Column:
        return F.pmod(F.xxhash64(case_id), F.lit(self.buckets)).cast("int")

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return empty_reports(self.spark)
        return self.spark.read.schema(REPORTS_SCHEMA).parquet(*[f"{self.base}/{f}" for f in folders])

    def read(self) -> DataFrame:
        latest = self.log.latest()
        return self._read(sorted(latest[1]["folders"].values()) if latest else [])

    def upsert(self, generated: DataFrame, *, now: Column | None = None, refresh: bool = False) -> list[int]:
        """Merge ``generated`` (case_id, report_text; one row a case) as ``upsert_reports`` does. Returns the buckets written."""
        number, state = self.log.latest() or (0, {"folders": {}, "last_id": 0, "buckets": self.buckets})
        fresh = materialise(generated.select("case_id", "report_text"), "generated")
        touched = sorted(r[0] for r in fresh.select(self._bucket()).distinct().collect())  # at most ``buckets`` numbers
        if not touched:
            return []
        old = self._read([state["folders"][str(b)] for b in touched if str(b) in state["folders"]])
        merged = materialise(upsert_reports(old, fresh, now=now, refresh=refresh, last_id=state["last_id"]), "merged")
        version = uuid.uuid4().hex
        out = merged.withColumn("bucket", self._bucket())
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.base}/{version}")
        last = merged.agg(F.max("id")).first()[0]
        folders = state["folders"] | {str(b): f"{version}/bucket={b}" for b in touched}
        self.log.commit(number + 1, {"folders": folders, "last_id": max(last, state["last_id"]), "buckets": self.buckets})
        return touched
