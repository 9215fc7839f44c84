"""The log as a stream equals the log as a table."""

from datetime import datetime

from quillspan.streaming import log


def test_hours(spark, tmp_path):
    t = datetime(2026, 1, 1)
    rows = [(3600.0 * 5, "a", None, 0.5, 1, "x", 1, t), (3600.0 * 5 + 9, "b", "y", 0.1, 0, "", 2, t), (3600e3 * 6 * 1e6 / 1e6 + 5e11, "c", None, None, 1, "x", -1, t)]
    frame = spark.createDataFrame(rows, log.SCHEMA)
    frame.write.parquet(str(tmp_path / "log"))
    frame.limit(1).write.mode("append").parquet(str(tmp_path / "log"))  # repeated
    stream = log.hourly(log.unique_rows(log.read_log(spark, str(tmp_path / "log")), late="36500 days"))
    got = sorted(map(tuple, log.run_once(stream, "t", mode="complete").collect()))
    late = int((3600e3 * 6 + 5e11) / 1000 // 3600)
    assert got == [(5, 2, 1), (late, 1, 1)]
    kept = log.run_once(log.unique_rows(log.read_log(spark, str(tmp_path / "log")), late="36500 days"), "u")
    assert kept.count() == 3
