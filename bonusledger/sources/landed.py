"""Time entries landed once, and the month hours kept up with them.

``entries``  parquet by month and file: later reports prune months instead of parsing
             XML again, and landing a file once more replaces it
``hours``    month hours (A2) by month: landing files recomputes the months they hold
             and no others

Which months and quarters there are is answered from the folders' names.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bookings as BK
from ..session import materialize


def months_landed(spark: SparkSession, path: str) -> list[date]:
    """The months of a landed table, from the names of its files."""
    found = {re.search(r"/month=(\d{4}-\d{2}-\d{2})/", f) for f in spark.read.parquet(path).inputFiles()}
    return sorted({date.fromisoformat(m[1]) for m in found if m})


def _months(spark: SparkSession, path: str) -> DataFrame:
    months = spark.createDataFrame([(m,) for m in months_landed(spark, path)], "month date")
    return months.withColumn("quarter", S.quarter_start("month"))


def quarters_available(spark: SparkSession, path: str) -> DataFrame:
    """A7 over a landed table; no data file is read."""
    return BK.quarters_available(_months(spark, path))


def latest_quarter(spark: SparkSession, path: str) -> DataFrame:
    """O2 over a landed table; no data file is read."""
    return BK.latest_quarter(_months(spark, path))


def land_entries(entries: DataFrame, path: str) -> list[date]:
    """Lands the entries of time files, each (month, file) replacing what was landed
    of it before, and gives the months they hold now or held before.  Rows are
    dealt by month and file, small ones together and large ones split (a rebalance by
    measured sizes), and sorted by day.  Entries without a date are in
    no month and stay out, as they do of every report."""
    spark = entries.sparkSession
    entries = entries.where("month is not null").withColumn("file", F.hex(F.xxhash64("source_file")))
    entries = materialize(entries, "landing")
    files = [r["file"] for r in entries.select("file").distinct().collect()]  # the files given
    months = {r["month"] for r in entries.select("month").distinct().collect()}
    stale = []
    if _exists(spark, path):
        folders = {re.search(r"/month=(\d{4}-\d{2}-\d{2})/file=([0-9A-F]+)/", f) for f in spark.read.parquet(path).inputFiles()}
        stale = [(date.fromisoformat(m[1]), m[2]) for m in folders if m and m[2] in files and date.fromisoformat(m[1]) not in months]
    for month, file in stale:  # a file that no longer holds a month it held
        _delete(spark, f"{path}/month={month}/file={file}")
    (entries.hint("rebalance", F.col("month"), F.col("file")).sortWithinPartitions("month", "file", "booked_on").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month", "file").parquet(path))
    return sorted(months | {m for m, _ in stale})


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("file")


def update_month_hours(spark: SparkSession, entries_path: str, hours_path: str, months: list[date]) -> None:
    """Month hours of the given months again, from those months' entries only."""
    left = set(months_landed(spark, entries_path))
    for gone in set(months) - left:
        _delete(spark, f"{hours_path}/month={gone}")
    if not left & set(months):
        return
    entries = read_entries(spark, entries_path).where(F.col("month").isin(sorted(left & set(months))))
    (BK.month_hours(entries).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("month").parquet(hours_path))


def land(entries: DataFrame, entries_path: str, hours_path: str) -> list[date]:
    """Lands entries and brings the month hours up to date; gives the months touched."""
    months = land_entries(entries, entries_path)
    if months:
        update_month_hours(entries.sparkSession, entries_path, hours_path, months)
    return months


def _folder(spark: SparkSession, path: str):
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    folder, fs = _folder(spark, path)
    return fs.exists(folder)


def _delete(spark: SparkSession, path: str) -> None:
    folder, fs = _folder(spark, path)
    fs.delete(folder, True)
