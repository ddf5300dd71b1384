from datetime import datetime, timedelta

from bitloom.streaming import windows

AT = datetime(2026, 1, 1)


def put(spark, path, *rows):
    """One file of (minute, type, value)."""
    data = [(AT + timedelta(minutes=m), t, v) for m, t, v in rows]
    spark.createDataFrame(data, "ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(path)


def test_late_events_are_counted_and_windows_close_once(spark, tmp_path):
    path, folder = str(tmp_path / "in"), str(tmp_path / "out")
    put(spark, path, (5, "a", 1.0), (59, "a", 2.0), (70, "b", 4.0))
    assert windows.run(spark, path, folder, "30 minutes") == 0
    assert windows.closed(spark, folder).count() == 0  # the watermark is at minute 40
    put(spark, path, (45, "a", 8.0), (130, "a", 16.0))  # late, but within the watermark
    assert windows.run(spark, path, folder, "30 minutes") == 0
    got = {(r.event_type, (r.start - AT).total_seconds() / 60): (r.n, r.micro) for r in windows.closed(spark, folder).collect()}
    assert got == {("a", 0.0): (3, 11_000_000)}
    put(spark, path, (50, "a", 32.0), (20, "b", 64.0), (300, "b", 1.0))  # the first two are beyond the watermark of minute 100
    assert windows.run(spark, path, folder, "30 minutes") == 2
    got = {(r.event_type, (r.start - AT).total_seconds() / 60): (r.n, r.micro) for r in windows.closed(spark, folder).collect()}
    assert got == {("a", 0.0): (3, 11_000_000), ("b", 60.0): (1, 4_000_000), ("a", 120.0): (1, 16_000_000)}
