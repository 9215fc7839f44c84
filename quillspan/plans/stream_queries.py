"""Streaming queries over the log, with the batch SQL that they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspan.streaming import log


def stream_log_by_hour(spark: SparkSession, folder: str) -> DataFrame:
    """Queries and abstentions by hour, from the stream without repeated rows."""
    stream = log.hourly(log.unique_rows(log.read_log(spark, f"{folder}/query_log.parquet"), late="3650 days"))
    return log.run_once(stream, "log-by-hour", mode="complete")


SQL = {
    "stream_log_by_hour": "SELECT CAST(floor((CASE WHEN ts > 1e11 THEN ts / 1000 ELSE ts END) / 3600) AS BIGINT) AS hour, count(*) AS queries, CAST(sum(abstained) AS BIGINT) AS abstained FROM (SELECT DISTINCT * FROM query_log) GROUP BY 1",
}
QUERIES = [stream_log_by_hour]
