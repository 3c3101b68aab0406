"""Ordered scans with chunks of three rows, chunks of chunks and so on, over several
files, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from bonusledger.operators import ordered


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(1)
    data = []
    for f in range(4):
        at = 0
        for _ in range((0, 1, 40, 130)[f]):
            at += r.choice([1, 1, 1, 2, 5, 30])
            data.append((f"f{f}", at, r.choice([None, None, None, "a", "b", "c"]), r.choice([None, 1, 2, -3])))
    return data


def test_scan_of_any_depth(spark, rows):
    df = spark.createDataFrame(rows, "file_path string, row_no long, v string, n long").repartition(5)
    want, now = {}, {}
    for f, at, v, n in rows:
        fill, total = now.get(f, (None, 0))
        now[f] = (v or fill, total + (n or 0))
        want[f, at] = (now[f][0], fill, now[f][1])
    assert ordered.depth(df, chunk=3) >= 5
    got = ordered.scan(df, {"fill": F.col("v")}, {"prior": F.col("v")}, {"total": F.col("n")}, chunk=3)
    assert got.columns == [*df.columns, "fill", "prior", "total"]
    assert {(r["file_path"], r["row_no"]): (r["fill"], r["prior"], r["total"]) for r in got.collect()} == want


def test_depth_keeps_windows_within_a_chunk():
    for last in (0, 2, 3, 8, 9, 26, 27, 80, 81, 10**6):
        levels, entries = ordered.depth_of(last, 3), last // 3 + 1
        for _ in range(levels - 1):
            entries = (entries - 1) // 3 + 1
        assert entries <= 3
    assert ordered.depth_of(None) == ordered.depth_of(10**6) == 1 and ordered.depth_of(10**12) == 2


def test_running_total_over_keys(spark):
    keys = [f"file-{i:03d}" for i in range(100)]
    df = spark.createDataFrame([(k, i % 7) for i, k in enumerate(keys)], "k string, n long").repartition(6)
    got = {r["k"]: r["upto"] for r in ordered.running_total(df, "k", F.col("n"), "upto", chunk=3).collect()}
    assert got == {k: sum(j % 7 for j in range(i + 1)) for i, k in enumerate(keys)}
    assert ordered.running_total(df.limit(0), "k", F.col("n"), "upto").collect() == []


def test_block_scan(spark):
    r = random.Random(2)
    data = [(f, b * 100, n, r.randint(0, 9)) for f in "xy" for b in range(7) for n in sorted(r.sample(range(50), r.randint(1, 9)))]
    df = spark.createDataFrame(data, "f string, b long, n long, v long").repartition(4)
    got = {(x["f"], x["b"], x["n"]): (x["upto"], x["before"]) for x in ordered.block_scan(
        df, "f", "b", "n", {"upto": F.col("v")}, {"before": F.col("v")}).collect()}
    total, last = {"x": 0, "y": 0}, {"x": None, "y": None}
    for f, b, n, v in data:
        total[f] += v
        assert got[f, b, n] == (total[f], last[f])
        last[f] = v
