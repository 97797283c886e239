"""Session settings the library relies on, and stage tables that survive executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Timestamps carry no zone in this library, so the session zone only matters
# where Spark functions pass through zoned timestamps (date_trunc).
REQUIRED_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(cores: int | str = "*", app_name: str = "cellgrid", **conf: str) -> SparkSession:
    """Session for tests and the bench. On a cluster use spark-submit and ``configure``."""
    n_shuffle = "8" if cores == "*" else str(cores)
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", n_shuffle)
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in {**REQUIRED_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the results depend on to a session someone else created."""
    for key, value in REQUIRED_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where none is set, a local session (one machine, as in tests) gets a temporary one; on a cluster
    that is an error, since each executor would write to a disk of its own.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def drop_stages(spark: SparkSession) -> None:
    """Remove this application's stage tables; frames that read them must not be used any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/cellgrid-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage_path(spark: SparkSession, name: str) -> str:
    """A new path for a stage table in the shared folder."""
    application = spark.sparkContext.applicationId
    return f"{shared_folder(spark)}/cellgrid-{application}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str = "stage", *, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and continue from the files.

    For tables with several consumers: they are computed once, later scans prune columns,
    joins see real sizes, and a lost executor costs a re-read, not a recomputation.
    ``path`` reuses a path whose former content is no longer needed.
    """
    spark = df.sparkSession
    path = path or stage_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
