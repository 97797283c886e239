"""Versioned serving tables: a reload becomes visible to readers in one step, or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from .manifest import ManifestLog


class ServingStore:
    """Named tables under one folder; each reload writes a new version of all of them.

    The manifest of a version appears in one step after every table is written, so a reader sees
    either the previous set of tables or the complete new one, and of two reloads at once one fails.
    """

    TABLES = ("cases", "sources", "reports")

    def __init__(self, spark: SparkSession, base: str) -> None:
        self.spark = spark
        self.base = base.rstrip("/")
        self.log = ManifestLog(spark, f"{self.base}/_manifests")

    def _latest(self) -> tuple[int, str] | None:
        latest = self.log.latest()
        return (latest[0], latest[1]["version"]) if latest else None

    def reload(self, tables: Mapping[str, DataFrame]) -> str:
        """Replace all tables by ``tables`` (cases, sources, reports). FileExistsError where another reload came first: then nothing changes."""
        missing = set(self.TABLES) - set(tables)
        if missing:
            raise ValueError(f"a reload needs all tables; missing {sorted(missing)}")
        latest = self._latest()
        version = uuid.uuid4().hex
        for name in self.TABLES:
            tables[name].write.mode("error").parquet(f"{self.base}/{version}/{name}")
        self.log.commit(latest[0] + 1 if latest else 1, {"version": version})
        return version

    def remove_old(self) -> list[str]:
        """Delete the tables of all versions but the current one, which readers must have left. Returns the deleted versions."""
        files = self.log.numbers()
        gone = [self.log.read(n)["version"] for n in files[:-1]]  # one a reload
        for version in gone:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{version}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return gone

    def read(self, name: str) -> DataFrame:
        latest = self._latest()
        if latest is None:
            raise FileNotFoundError(f"nothing has been loaded into {self.base}")
        return self.spark.read.parquet(f"{self.base}/{latest[1]}/{name}")

    def replace(self, name: str, table: DataFrame) -> str:
        """New version in which only ``name`` changes; ``table`` may be derived from the current version."""
        return self.reload({n: table if n == name else self.read(n) for n in self.TABLES})

    def create_views(self) -> None:
        """Temporary views for ad-hoc SQL over the current version."""
        for name in self.TABLES:
            self.read(name).createOrReplaceTempView(name)
