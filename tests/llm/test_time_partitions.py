"""Adaptive time partitions against a recursive version on lists."""

import calendar
import datetime as dt
import hashlib
import os
import random
import uuid
import zlib

import pyarrow.parquet as pq
import pytest

from quillspark.llm import common, time_partitions

SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, leaf int, part string"
CUT = dt.datetime(2024, 5, 1)


def moment(ts, i):
    if ts is None or i is None:
        return ts
    k = zlib.crc32(str(i).encode()) % 128
    if k < 16:
        return ts - dt.timedelta(days=(k + 6) ** 3)
    if k > 111:
        d = ts.date() - dt.timedelta(days=ts.weekday())
        return dt.datetime(d.year, d.month, d.day)
    return ts


def children(name, level):
    if level == 1:
        return [f"{m:02d}" for m in range(1, 13)]
    if level == 2:
        return [f"{d:02d}" for d in range(1, calendar.monthrange(*map(int, name.split("/")))[1] + 1)]
    return [f"{h:02d}" for h in range(24)]


LABEL = [lambda m: f"{m.year:04d}", lambda m: f"{m.month:02d}", lambda m: f"{m.day:02d}", lambda m: f"{m.hour:02d}"]


def brute_layout(rows, limit):
    leaves = {}

    def fold(labels, rows, name, level):
        under, run, done = {x: [] for x in labels}, None, []
        for r in rows:
            under[LABEL[level](r[0])].append(r)
        for label, own in under.items():
            if len(own) > limit:
                run = None
                if level == 3:
                    done.append([label, label, own])
                else:
                    below = f"{name}{label}"
                    fold(children(below, level + 1), own, below + "/", level + 1)
            elif run is not None and len(run[2]) + len(own) <= limit:
                run[1] = label
                run[2] += own
            else:
                run = [label, label, own]
                done.append(run)
        leaves.update({f"{name}{a}-{b}": own for a, b, own in done if own})

    timed = [r for r in rows if r[0] is not None]
    if timed:
        years = [r[0].year for r in timed]
        fold([f"{y:04d}" for y in range(min(years), max(years) + 1)], timed, "", 0)
    if len(timed) < len(rows):
        leaves["null"] = [r for r in rows if r[0] is None]
    files = {}
    for leaf, own in leaves.items():
        own = sorted(own, key=lambda r: tuple((x is not None, x or dt.datetime.min) if i < 2 else (x is not None, x or 0) for i, x in enumerate(r[:3])))
        files.update({(leaf, p // limit + 1): own[p : p + limit] for p in range(0, len(own), limit)})
    return files


def brute(rows):
    limit = 1 + len(rows) // 500
    all_rows = [(moment(r[1], r[0]), r[2], r[0], r) for r in rows]
    early = [r for r in all_rows if r[1] is not None and r[1] < CUT]
    start, final = brute_layout(early, limit), brute_layout(all_rows, limit)
    out = {}
    for at, own in final.items():
        ids = ",".join("" if r[2] is None else str(r[2]) for r in own)
        same = at in start and sorted(map(str, start[at])) == sorted(map(str, own))
        out[at] = (hashlib.sha256(ids.encode()).hexdigest(), len(own), sum(r[1] is None or r[1] >= CUT for r in own), not same)
    return out


def some_rows(n, seed=5):
    rng, rows = random.Random(seed), []
    for i in range(n):
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.random() ** 2 * 150 * 86400)
        if rng.random() < 0.3:  # a third of the rows in one hour, many at one moment
            ts = dt.datetime(2024, 2, 7, 9, rng.randrange(3))
        arrived = ts if rng.random() < 0.5 and ts.day < 25 else ts + dt.timedelta(seconds=rng.randrange(1, 86400 * 20))
        rows.append((i if rng.random() > 0.01 else None, ts if rng.random() > 0.05 else None, arrived if rng.random() > 0.02 else None, rng.randrange(9), "v" * 5000 if i == 3 else None))
    return rows + rng.sample(rows, n // 20)


@pytest.mark.parametrize("n", [0, 40, 1600])
def test_two_layouts(spark, tmp_path, n):
    rows = some_rows(n)
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/clicks.parquet")
    got = time_partitions.query(spark, str(tmp_path)).collect()
    assert {(r.leaf, r.part): (r.ids_sha256, r.n_rows, r.n_new, r.rewritten) for r in got} == brute(rows)
    held = 0
    for r in got:
        t = pq.ParquetFile(r.path.removeprefix("file:")).read()
        assert ",".join(t.column_names) == r.columns == "click_id,ts,arrived_at,leaf,part"
        assert hashlib.sha256(",".join("" if x is None else str(x) for x in t["click_id"].to_pylist()).encode()).hexdigest() == r.ids_sha256
        held += t.num_rows
    assert held == len(rows)
    if got:
        top = got[0].path.removeprefix("file:").split("/leaves/")[0]
        assert sum(f.endswith(".parquet") for _, _, fs in os.walk(top) for f in fs) == len(got)


def test_equal_rows_and_no_moments(spark, tmp_path):
    rows = [(1, None, None, 1, "a")] * 3 + [(2, dt.datetime(2024, 2, 29, 23), dt.datetime(2024, 3, 1), 1, "a")] * 4
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/clicks.parquet")
    got = time_partitions.query(spark, str(tmp_path)).collect()
    assert {(r.leaf, r.part): (r.ids_sha256, r.n_rows, r.n_new, r.rewritten) for r in got} == brute(rows)


def test_rewrite_again(spark):
    """Any key, order and limit; a second rewrite of the same rows moves nothing."""
    df = spark.createDataFrame([(i, dt.datetime(2020 + i % 3, 1 + i % 12, 1), {"k": i}) for i in range(60)], "id int, at timestamp_ntz, m map<string,int>")
    folder = f"{common.shared_dir(spark)}/layout-{uuid.uuid4().hex}"

    def rewrite(rows):
        counts = common.written(time_partitions.hours(rows, time_partitions.F.col("at"), {"n": time_partitions.F.lit(True)}), "hours")
        return time_partitions.rewritten(rows, folder, time_partitions.planned(counts, "n", 10), 10, time_partitions.F.col("at"), ["id"]).collect()

    first, again, less = rewrite(df), rewrite(df), rewrite(df.where("id < 57"))
    assert all(r.rewritten for r in first) and not any(r.rewritten for r in again)
    assert {r.name for r in first} == {r.name for r in again}
    assert sum(r.n_rows for r in less) == 57 and 0 < sum(r.rewritten for r in less) < len(less)


def test_runs():
    assert time_partitions.runs([0, 0, 4, 6, 1, 11, 0, 10, 0], 10) == [(0, 3, 10), (4, 4, 1), (5, 5, 11), (6, 8, 10)]
