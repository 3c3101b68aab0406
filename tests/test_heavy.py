"""Joins on a key that holds a third of all rows: equal results, no task with much
more rows than the others."""

from collections import Counter
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bonusledger.operators import bookings as BK
from bonusledger.operators import heavy
from bonusledger.operators import rules as RU

N = 60_000


@pytest.fixture
def many_tasks(spark):
    """64 shuffle partitions, no broadcast and no help from adaptive plans."""
    conf = {"spark.sql.shuffle.partitions": "64", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.fixture
def month_hours(spark):
    """Every third row on one key; 4,000 employees, 500 keys, three months."""
    i = F.col("id")
    hot = i % 3 == 0
    return spark.range(N).select(
        F.concat(F.lit("S"), F.floor(i / 15).cast("string")).alias("staff_name"), F.lit(date(2025, 1, 1)).alias("quarter"),
        F.add_months(F.lit(date(2025, 1, 1)), (F.floor(i / 5) % 3).cast("int")).alias("month"),
        F.when(hot, F.lit("0000 Intern")).otherwise(F.concat((1000 + i % 500).cast("string"), F.lit(".01 P"))).alias("proj_norm"),
        F.lit("1.1 M").alias("ms_norm"), F.lit(Decimal("1.5")).cast("decimal(30,8)").alias("hours")).groupBy(
        "staff_name", "quarter", "month", "proj_norm", "ms_norm").agg(F.sum("hours").cast("decimal(30,8)").alias("hours"))


def shares(df):
    """Rows of the largest task by those of the median one that has any."""
    counted = df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(df.columns[-1]))  # the joined column is used
    sizes = sorted(r["n"] for r in counted.collect())
    return sizes[-1] / sizes[len(sizes) // 2]


def plan_of(mh):
    return mh.select(*RU.KEY).distinct().withColumns({
        "soll": F.lit(Decimal("900")).cast("decimal(30,8)"), "ist": F.lit(Decimal("400")).cast("decimal(30,8)")})


def same(a, b):
    return Counter(map(tuple, a.collect())) == Counter(map(tuple, b.collect()))


def test_sketch_finds_every_frequent_key(spark):
    rows = spark.range(100_000).select((F.when(F.col("id") % 10 == 0, F.lit(-1)).otherwise(F.col("id"))).alias("k"))
    hashes = [r[0] for r in spark.range(1).select(F.xxhash64(F.lit(-1).cast("long"))).collect()]
    hot = heavy.hot_keys(rows.repartition(13), ["k"])
    assert hashes[0] in hot.hashes and len(hot.hashes) <= 200
    assert heavy.hot_keys(rows.limit(0), ["k"]).hashes == ()


def test_month_rows_spread_a_hot_key(spark, month_hours, many_tasks):
    plan, hot = plan_of(month_hours), RU.hot_keys(month_hours)
    plain, spread = RU.month_rows(month_hours, plan), RU.month_rows(month_hours, plan, hot)
    assert shares(plain) > 5 and shares(spread) < 4
    assert same(plain, spread)


def test_coworkers_spread_a_hot_key(spark, month_hours, many_tasks):
    hot = RU.hot_keys(month_hours)
    plain, spread = RU.coworkers(month_hours), RU.coworkers(month_hours, hot)
    assert shares(plain) > 5 and shares(spread) < 4
    assert same(plain, spread)


def test_revenue_spreads_a_hot_key(spark, month_hours, many_tasks):
    hot, plan = RU.hot_keys(month_hours), plan_of(month_hours)
    none = spark.createDataFrame([], "staff_name string, proj_norm string, ms_norm string, month date, adj_h decimal(18,2), assign_to string")
    positions = spark.createDataFrame([("S1", "CAD"), ("S2", "-")], "staff_name string, position string")
    rows = RU.landed_rows(RU.with_adjustments(RU.month_rows(month_hours, plan, hot), none))
    resolved = month_hours.select(*RU.KEY).distinct().withColumns({
        "lookup_id": F.lit(1), "billing": F.lit("Nachweis"), "rate_sv": F.lit(10.0), "rate_cad": F.lit(8.0), "rate_adm": F.lit(6.0),
        "budget_total": F.lit(Decimal("100"))})
    columns = ["staff_name", "month", *RU.KEY, "revenue", "revenue_key"]
    plain = RU.revenue_rows(rows, resolved, positions).select(columns)
    spread = RU.revenue_rows(rows, resolved, positions, hot).select(columns)
    assert shares(plain) > 5 and shares(spread) < 4
    assert same(plain, spread)
    quarter = RU.quarter_summary(rows, plan)
    assert same(quarter, RU.quarter_summary(rows, plan, hot))
    a, b = (RU.quarter_revenue(quarter, resolved, positions, h).select("staff_name", *RU.KEY, "revenue", "revenue_key") for h in (None, hot))
    assert same(a, b)


def test_future_hours_of_a_hot_key(spark, month_hours, many_tasks):
    fut = {(r["proj_norm"], r["month"].month): r["future_hours"] for r in BK.future_hours_all_staff(month_hours).collect()}
    of = {}
    for r in month_hours.where("proj_norm = '0000 Intern'").collect():
        of[r["month"].month] = of.get(r["month"].month, 0) + r["hours"]
    assert fut["0000 Intern", 1] == of[2] + of[3] and fut["0000 Intern", 3] == 0


def test_other_joins_are_refused(spark, month_hours):
    with pytest.raises(ValueError, match="left and inner"):
        heavy.join(month_hours, month_hours, RU.KEY, RU.hot_keys(month_hours), ["month"], "full")
