"""Session defaults and the shared folder for intermediate tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_scratch: dict[str, str] = {}


def session(app: str = "quillspan", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library expects (UTC, AQE with skew handling, Arrow)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables.

    It lies in the shared folder that the cluster names in
    ``spark.checkpoint.dir``. Only where that is unset (a local session, as in
    tests) a temporary folder is made. The folder goes when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _scratch:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if not shared:
            if spark.sparkContext.master.partition("[")[0] != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = "file://" + tempfile.mkdtemp(prefix="quillspan-")
        _scratch[app] = f"{shared.rstrip('/')}/quillspan-{app}"
        atexit.register(_remove, spark, _scratch[app])
    return _scratch[app]


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the JVM may be gone already; only a folder that belongs to this process alone is left to remove
        if folder.startswith("file:///tmp/"):
            import shutil

            shutil.rmtree(os.path.dirname(folder.removeprefix("file://")), ignore_errors=True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again.

    This cuts the lineage, so that lost executors don't cause the work before it
    to be done again, and it makes a result that several later steps read stable.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
