"""Streams that run: late rows, restarts, repeated events, and their batch twins."""

import datetime as dt
import tempfile

import duckdb
import pytest

from quillspark.plans import catalog
from quillspark.plans import queries as _queries  # noqa: F401
from quillspark.streaming import flows

SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
START = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def event(i, minutes, user=1, kind="a"):
    return (i, START + dt.timedelta(minutes=minutes), user, kind, float(i))


def put(spark, root, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{root}/in")


def stream(spark, root):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{root}/in")


def test_windows_with_late_rows_and_restart(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    run = lambda: flows.run_available(flows.windowed_counts(stream(spark, root)), f"{root}/out", f"{root}/state")
    put(spark, root, [event(1, 5), event(2, 50), event(3, 70)])
    put(spark, root, [event(4, 400)])
    first = run()
    put(spark, root, [event(5, 10), event(6, 401), event(7, 800)])  # 5 comes after its window was closed
    second = run()
    assert (first["rows"], first["late"]) == (4, 0) and (second["rows"], second["late"]) == (3, 1)
    got = {(int((r.window_start.replace(tzinfo=dt.UTC) - START).total_seconds() // 3600), r.events) for r in spark.read.parquet(f"{root}/out").collect()}
    assert got == {(0, 2), (1, 1), (6, 2)}


def test_repeated_events(spark):
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    put(spark, root, [event(1, 5), event(1, 5), event(2, 6)])
    put(spark, root, [event(1, 5), event(3, 7)])
    flows.run_available(flows.once(stream(spark, root)), f"{root}/out", f"{root}/state")
    assert sorted(r.event_id for r in spark.read.parquet(f"{root}/out").collect()) == [1, 2, 3]


@pytest.mark.parametrize("name", ["event_windows_streamed", "event_sessions_streamed"])
def test_registered_streams(spark, name):
    sf = "/root/testdata/sf0.001"
    got = sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{sf}/events.parquet'")
    expected = sorted(tuple(r) for r in con.execute(catalog.ORACLES[name]).fetchall())
    assert len(got) == len(expected) and [tuple(map(str, r)) for r in got] == [tuple(map(str, r)) for r in expected]
