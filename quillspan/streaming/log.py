"""The query log as a stream: an extension beyond the reference, which has none."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.session import scratch_dir

SCHEMA = "ts double, question string, answer string, risk double, abstained int, reason string, passage_id bigint, written_at timestamp"


def read_log(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """New Parquet files of the log as they come, with ``event_time`` (times in milliseconds are brought to seconds)."""
    import os

    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch)
    single = os.path.isfile(path.removeprefix("file://"))
    log = reader.option("pathGlobFilter", name).parquet(folder) if single else reader.parquet(path)
    seconds = F.when(F.col("ts") > 1e11, F.col("ts") / 1000).otherwise(F.col("ts"))
    return log.withColumn("event_time", F.timestamp_micros(F.round(seconds * 1e6).cast("bigint")))


def unique_rows(log: DataFrame, late: str = "30 days") -> DataFrame:
    """Rows without repetitions; state is kept for as long as rows may be late."""
    return log.withWatermark("event_time", late).dropDuplicatesWithinWatermark(["ts", "question", "answer", "risk", "abstained", "reason", "passage_id", "written_at"])


def hourly(log: DataFrame) -> DataFrame:
    """Queries and abstentions by hour of the event."""
    return log.groupBy(F.window("event_time", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("queries"), F.sum("abstained").alias("abstained")).select(F.floor(F.unix_seconds("w.start") / 3600).alias("hour"), "queries", "abstained")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what there is and return its result as a table in the shared folder."""
    import uuid

    spark = stream.sparkSession
    base = f"{scratch_dir(spark)}/stream-{name}-{uuid.uuid4().hex[:12]}"
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{base}/rows")

    def keep(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/rows-{epoch}")
        last.append(f"{base}/rows-{epoch}")

    last: list[str] = []
    query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{base}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(last[-1]) if last else spark.createDataFrame([], stream.schema)
