"""Adaptive time partitions: a table in Parquet files whose time spans follow
the density of its rows.

A layout is a tree of years, months, days and hours with a limit of rows. A
node above the limit is split into all its children. In time order, a sibling
within the limit, even an empty one, joins the run of the sibling right before
it if that stays within the limit, else it starts a run. Runs with rows are
leaves; so are hours above the limit, alone, and all rows without a moment. A
leaf's rows, in their order, fill parts of `limit` rows, one file each.

Planning is distributed: rows are counted by hour, `applyInPandas` plans
months, days and hours inside each year's histogram independently, and a final
small pass over the years' totals folds years into runs and drops the subplans
of years that need none. A year has 8,784 counts at most, whatever the rows.

Rows meet the plan by four broadcast look-ups (year, month, day, hour). Only
nodes above the limit have children in the plan, so for limits in proportion to
the rows (here a 500th) it has at most 500 * (12 + 31 + 24) members and the
years: that is the bound of what is broadcast. Rows of a leaf beyond the limit
(a single hour, or no moment: they may be most of the table) are ranked
by a range partitioning over all sort keys: a task sorts one range, and the
counts of the ranges give each its first rank. Each file is written by one task
that sorts by spilling and streams.

A rewrite finds files of the same leaf, part and rows by count and four sums
of halves of two 64-bit row hashes, grouped by file: the order is a function of the rows. Such files
stay, the others are written to a hidden folder beside them, moved in, and
files that are not of the layout are deleted. The number of files, which the
driver lists, is at most rows / limit plus the leaves.

Defined cases: rows without a moment are the leaf `null`; nulls sort first;
repeated rows are all kept, in any order among themselves; texts of any length
are values like others; rows that agree in all sort keys are ordered by a hash
of all columns; an empty table has no file; further columns are stored as
they are, whatever their names (maps count by their sorted entries; maps within
other types are not supported).
"""

from __future__ import annotations

import calendar
import hashlib
import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from . import common

NULL_LEAF = "null"
MEMBERS = "key long, leaf string, leaf_rows long"
#: What a node's number is multiplied by in its key, from years to hours; hours count from 1 there.
STEPS = (1_000_000, 10_000, 100, 1)


# ---------------------------------------------------------------- planning


def runs(rows: Sequence[int], limit: int) -> list[tuple[int, int, int]]:
    """(first, last, rows) of the runs of siblings; one above the limit stands alone."""
    out: list[tuple[int, int, int]] = []
    for i, n in enumerate(rows):
        if out and out[-1][2] + n <= limit:
            out[-1] = (out[-1][0], i, out[-1][2] + n)
        else:
            out.append((i, i, n))
    return out


def members_below(name: str, key: int, counts: np.ndarray, limit: int, level: int = 1) -> Iterator[tuple[int, str, int]]:
    """(key, leaf, leaf_rows) of the children of a node and what is below them;
    counts has an axis for each level below the node."""
    from_ = 0 if level == 3 else 1
    rows = counts.reshape(len(counts), -1).sum(1).tolist()
    keys = [key + (i + 1) * STEPS[level] for i in range(len(rows))]
    for a, b, n in runs(rows, limit):
        if n > limit and level < 3:
            below = counts[a]
            if level == 1:
                below = below[: calendar.monthrange(key // STEPS[0], a + 1)[1]]
            yield from members_below(f"{name}/{a + from_:02d}", keys[a], below, limit, level + 1)
        elif n:
            leaf = f"{name}/{a + from_:02d}-{b + from_:02d}"
            yield from ((keys[i], leaf, n) for i in range(a, b + 1) if rows[i])


def hours(df: DataFrame, moment: Column, counts: dict[str, Column]) -> DataFrame:
    """(year, month, day, hour) with the counts of rows where each condition
    holds; all four are null for rows without a moment."""
    of = [f(moment).cast("int").alias(n) for n, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth), ("hour", F.hour))]
    return df.select(*of, *(c.alias(n) for n, c in counts.items())).groupBy("year", "month", "day", "hour").agg(*(F.sum(F.coalesce(F.col(n), F.lit(False)).cast("long")).alias(n) for n in counts))


def planned(histogram: DataFrame, rows: str, limit: int) -> DataFrame:
    """The members (key, leaf, leaf_rows) of a layout; the key of rows without
    a moment is 0."""

    def inside(part: pd.DataFrame) -> pd.DataFrame:
        year = int(part["year"].iloc[0])
        counts = np.zeros((12, 31, 24), np.int64)
        np.add.at(counts, (part["month"] - 1, part["day"] - 1, part["hour"]), part["n"])
        found = [*members_below(f"{year:04d}", year * STEPS[0], counts, limit), (year * STEPS[0], None, int(counts.sum()))]
        return pd.DataFrame(found, columns=["key", "leaf", "leaf_rows"])

    def folded(years: pd.DataFrame) -> pd.DataFrame:
        total = dict(zip((years["key"] // STEPS[0]).tolist(), years["leaf_rows"].tolist(), strict=True))
        first, found = min(total), []
        for a, b, n in runs([total.get(y, 0) for y in range(first, max(total) + 1)], limit):
            leaf = f"{first + a:04d}-{first + b:04d}" if n <= limit else None
            found += [(y * STEPS[0], leaf, n) for y in range(first + a, first + b + 1) if y in total and n]
        return pd.DataFrame(found, columns=["key", "leaf", "leaf_rows"])

    given = histogram.where(f"{rows} > 0")
    subplans = common.written(given.where("year IS NOT NULL").select("year", "month", "day", "hour", F.col(rows).alias("n")).groupBy("year").applyInPandas(inside, MEMBERS), "subplans")
    years = subplans.where("leaf IS NULL").groupBy(F.lit("years")).applyInPandas(folded, MEMBERS)
    years = common.written(years, "years")
    split = years.where("leaf IS NULL").select((F.col("key") / STEPS[0]).cast("long").alias("year"))
    used = subplans.where("leaf IS NOT NULL").join(F.broadcast(split), F.floor(F.col("key") / STEPS[0]) == F.col("year"), "left_semi")
    nulls = given.where("year IS NULL").select(F.lit(0).cast("long").alias("key"), F.lit(NULL_LEAF).alias("leaf"), F.col(rows).alias("leaf_rows"))
    return common.written(years.where("leaf IS NOT NULL").unionByName(used).unionByName(nulls), "plan")


# ------------------------------------------------------------- rows to files


class Table:
    """A table with the moment and the order of its rows. Helper columns have
    names that the table has not."""

    def __init__(self, df: DataFrame, moment: Column, order: list[str], new: Column | None = None):
        self.df, self.columns = df, df.columns
        self.moment, self.leaf, self.part, self.tie, self.new, self.file = (common.fresh(df, n) for n in ("moment", "leaf", "part", "tie", "is_new", "file_no"))
        values = [F.array_sort(F.map_entries(c)) if isinstance(df.schema[c].dataType, MapType) else F.col(f"`{c}`") for c in df.columns]
        self.hashes = [F.xxhash64(*values), F.xxhash64(F.lit("second"), *values)]
        self.order = [self.moment, *order, self.tie]
        self.rows = df.select("*", moment.alias(self.moment), self.hashes[0].alias(self.tie), F.coalesce(new if new is not None else F.lit(False), F.lit(True)).alias(self.new))

    def sums(self) -> list[Column]:
        """Count and sums that tell the rows of a file from other rows."""
        halves = [x for h in self.hashes for x in (F.shiftrightunsigned(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
        return [F.count(F.lit(1)).alias("n_rows"), *(F.sum(x).alias(f"s{i}") for i, x in enumerate(halves))]


def placed(t: Table, members: DataFrame, limit: int) -> DataFrame:
    """The rows with leaf and part."""
    spark, m = t.df.sparkSession, F.col(t.moment)
    keys = [F.year(m) * F.lit(STEPS[0]).cast("long")]
    keys.append(keys[0] + F.month(m) * STEPS[1])
    keys.append(keys[1] + F.dayofmonth(m) * STEPS[2])
    keys.append(keys[2] + F.hour(m) + 1)
    out, found, at = t.rows, [], common.fresh(t.df, "at")
    for i, key in enumerate(keys):
        look = members.select(F.col("key").alias(f"{at}{i}"), F.struct("leaf", "leaf_rows").alias(f"{at}v{i}"))
        out = out.join(F.broadcast(look), F.coalesce(key, F.lit(0)) == look[f"{at}{i}"], "left")
        found.append(F.col(f"{at}v{i}"))
    out = out.select(*t.rows.columns, F.coalesce(*found).alias(at))
    own = [*t.rows.columns, F.col(f"{at}.leaf").alias(t.leaf)]
    cold = out.where(F.col(f"{at}.leaf_rows") <= limit).select(*own, F.lit(1).cast("long").alias(t.part))
    if members.where(F.col("leaf_rows") > limit).isEmpty():
        return cold
    row, pid = common.fresh(t.df, "row"), common.fresh(t.df, "pid")
    keys = [t.leaf, *t.order, row]
    hot = out.where(F.col(f"{at}.leaf_rows") > limit).select(*own, F.monotonically_increasing_id().alias(row))
    hot = hot.repartitionByRange(common.partitions_for(spark), *keys).sortWithinPartitions(*keys)
    hot = common.written(hot.withColumn(pid, F.spark_partition_id()).withColumn(row, F.monotonically_increasing_id()), "hot")
    ranges = hot.groupBy(t.leaf, pid).agg(F.count(F.lit(1)).alias("n"), F.min(row).alias("first"))
    before = Window.partitionBy(t.leaf).orderBy(pid).rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(F.col(t.leaf).alias("l"), F.col(pid).alias("p"), (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    # a row for each range and leaf: as many as shuffle partitions and leaves
    ranked = hot.join(F.broadcast(ranges), (hot[t.leaf] == ranges["l"]) & (hot[pid] == ranges["p"]))
    return cold.unionByName(ranked.select(*t.rows.columns, t.leaf, (F.floor((F.col(row) + F.col("shift")) / limit) + 1).alias(t.part)))


FILES = "/leaves/"


def present(t: Table, folder: str) -> DataFrame:
    """(path, leaf, part, n_rows, sums) of the files in a folder."""
    files = t.df.sparkSession.read.option("recursiveFileLookup", "true").schema(t.df.schema).parquet(folder + FILES)
    path = F.col("_metadata.file_path")
    named = lambda i: F.regexp_extract("path", r"/leaves/(.*)/(part-(\d+)-\w+\.parquet)$", i)
    return files.groupBy(path.alias("path")).agg(*t.sums()).select(named(1).alias("leaf"), named(3).cast("long").alias("part"), named(2).alias("name"), "n_rows", "s0", "s1", "s2", "s3")


def _files(spark: SparkSession, path: str):
    """(file system, path) by Hadoop's API, which knows all stores of Spark."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def rewritten(df: DataFrame, folder: str, members: DataFrame, limit: int, moment: Column, order: list[str], new: Column | None = None) -> DataFrame:
    """Make `folder` hold `df` in the planned layout. Returns (leaf, part, name,
    n_rows, n_new, rewritten) of its files, n_new being the rows with `new`."""
    spark, t = df.sparkSession, Table(df, moment, order, new)
    fs, root = _files(spark, folder + FILES)
    fs.mkdirs(root)
    rows = placed(t, members, limit)
    wanted = rows.groupBy(F.col(t.leaf).alias("leaf"), F.col(t.part).alias("part")).agg(*t.sums(), F.sum(F.col(t.new).cast("long")).alias("n_new"))
    same = ["leaf", "part", "n_rows", "s0", "s1", "s2", "s3"]
    before = common.written(present(t, folder), "present")
    kept = before.groupBy(*same).agg(F.min("name").alias("kept"))
    plan = common.written(wanted.join(kept, same, "left").select("leaf", "part", "n_rows", "n_new", "kept"), "files")
    # as many rows as files, which the limit bounds
    listed = plan.orderBy("leaf", "part").collect()
    todo = [(i, r.leaf, r.part) for i, r in enumerate(listed) if r.kept is None]
    names = {(r.leaf, r.part): r.kept for r in listed}
    hidden = f"{folder}/_new-{uuid.uuid4().hex}"
    if todo:
        numbers = spark.createDataFrame(todo, f"`{t.file}` int, __l string, __p long")
        some = rows.join(F.broadcast(numbers), (rows[t.leaf] == numbers["__l"]) & (rows[t.part] == numbers["__p"]))
        some = some.repartition(common.partitions_for(spark), t.file).sortWithinPartitions(t.file, *t.order)
        some.select(*(f"`{c}`" for c in t.columns), t.file).write.option("maxRecordsPerFile", 0).partitionBy(t.file).parquet(hidden)
    for i, leaf, part in todo:
        _, at = _files(spark, f"{hidden}/{t.file}={i}")
        made = [s.getPath() for s in fs.listStatus(at) if s.getPath().getName().endswith(".parquet")]
        if len(made) != 1:
            raise RuntimeError(f"{len(made)} files for part {part} of {leaf}")
        names[leaf, part] = f"part-{part:05d}-{uuid.uuid4().hex}.parquet"
        _, to = _files(spark, f"{folder}{FILES}{leaf}/{names[leaf, part]}")
        fs.mkdirs(to.getParent())
        if not fs.rename(made[0], to):
            raise RuntimeError(f"{to} could not be moved into place")
    stay = set(names.items())
    for r in before.select("leaf", "part", "name").collect():
        if ((r.leaf, r.part), r.name) not in stay:
            fs.delete(_files(spark, f"{folder}{FILES}{r.leaf}/{r.name}")[1], False)
    fs.delete(_files(spark, hidden)[1], True)
    return spark.createDataFrame([(r.leaf, r.part, names[r.leaf, r.part], r.n_rows, r.n_new, r.kept is None) for r in listed], "leaf string, part long, name string, n_rows long, n_new long, rewritten boolean")


def ids_digests(files: DataFrame, key: str) -> DataFrame:
    """(file, ids_sha256): of the decimal keys of each file in file order,
    comma-joined. One task streams the keys of a file."""

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, digest, out = None, None, []
        for b in batches:
            ids = pc.fill_null(pc.cast(b.column(1), pa.string()), "")
            names = b.column(0).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if lo == hi:
                    continue
                if names[lo] != name:
                    if name is not None:
                        out.append((name, digest.hexdigest()))
                    name, digest, mark = names[lo], hashlib.sha256(), ""
                digest.update((mark + ",".join(ids[lo:hi].to_pylist())).encode())
                mark = ","
        if name is not None:
            out.append((name, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.string()) for i in (0, 1)], names=["file", "ids_sha256"])

    rows = files.select(F.col("_metadata.file_name").alias("file"), F.col(key).alias("id"), F.col("_metadata.row_index").alias("at"))
    rows = rows.repartition(common.partitions_for(files.sparkSession), "file").sortWithinPartitions("file", "at")
    return rows.select("file", "id").mapInArrow(digested, "file string, ids_sha256 string")


# -------------------------------------------------------------------- query


def click_moment(ts: str = "ts", key: str = "click_id") -> Column:
    """The moment of a click: its time, moved back or floored to Monday by a
    hash of its id."""
    at = f"CAST(`{ts}` AS TIMESTAMP_NTZ)"
    k = f"crc32(CAST(`{key}` AS STRING)) % 128"
    back = f"CAST(({k} + 6) * ({k} + 6) * ({k} + 6) AS INT)"
    return F.expr(f"CASE WHEN {k} < 16 THEN {at} - make_dt_interval({back}) WHEN {k} > 111 THEN CAST(date_sub(CAST({at} AS DATE), weekday({at})) AS TIMESTAMP_NTZ) ELSE {at} END")


def two_layouts(clicks: DataFrame, folder: str, since: str = "2024-05-01 00:00:00", share: int = 500) -> DataFrame:
    """Write the rows that arrived before `since`, then all rows, into `folder`;
    the files of the second layout with digests of their ids."""
    spark, moment = clicks.sparkSession, click_moment()
    early = F.coalesce(F.col("arrived_at").cast("timestamp_ntz") < F.lit(since).cast("timestamp_ntz"), F.lit(False))
    counts = common.written(hours(clicks, moment, {"early": early, "every": F.lit(True)}), "hours")
    limit = 1 + math.floor((counts.agg(F.sum("every")).first()[0] or 0) / share)
    order = ["arrived_at", "click_id"]
    rewritten(clicks.where(early), folder, planned(counts, "early", limit), limit, moment, order)
    files = rewritten(clicks, folder, planned(counts, "every", limit), limit, moment, order, ~early)
    stored = spark.read.option("recursiveFileLookup", "true").schema(clicks.schema).parquet(folder + FILES)
    digests = common.written(ids_digests(stored, "click_id"), "digests")
    out = files.join(digests, files["name"] == digests["file"])
    return out.select("leaf", F.lit(",".join(stored.columns)).alias("columns"), "ids_sha256", F.concat(F.lit(folder + FILES), "leaf", F.lit("/"), "name").alias("path"), "part", "n_rows", "n_new", "rewritten")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return two_layouts(common.table(spark, sf_dir, "clicks"), f"{common.shared_dir(spark)}/time-partitions-{uuid.uuid4().hex}")
