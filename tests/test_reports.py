"""Report plans end to end on the smallest bridge data: dispatch, standard
quarterly job, flexible report, summaries, invariants."""

from datetime import date

import pytest
from pyspark.sql import functions as F

from bonusledger.operators import bookings as BK
from bonusledger.operators import rules as RU
from bonusledger.plans import reports as R
from bonusledger.session import materialize
from bonusledger.sources import bridge as BR

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def inputs(spark):
    return (BR.bookings(spark, SF), BR.budget_lines(spark, SF), BR.adjustments(spark, SF), BR.positions(spark, SF))


def test_config_checks():
    with pytest.raises(ValueError):
        R.ReportConfig("custom_period", date(2025, 2, 1), date(2025, 1, 1))
    with pytest.raises(ValueError):
        R.ReportConfig("quarterly", date(2025, 1, 1), date(2025, 2, 1))
    R.ReportConfig("quarterly", date(2025, 7, 1), date(2025, 9, 30))
    cfg_list = R.ReportConfig("project", date(2025, 1, 1), date(2025, 3, 31), projects=" 1003, 0000 Intern ,")
    assert cfg_list.projects == ["1003", "0000 Intern"]
    assert R.report_name(quarter=date(2025, 7, 1)) == "Q3-2025"
    cfg = R.ReportConfig("custom_period", date(2025, 1, 1), date(2025, 3, 31))
    assert R.report_name(cfg, prefix="X") == "X_Report_20250101-20250331"


def test_quarterly_job_latest_and_requested(spark, inputs):
    entries, lines, adj, pos = inputs
    q, tables = R.quarterly_job(entries, lines, adj, pos)
    assert q == entries.agg(F.max("quarter")).first()[0]
    q2, tables2 = R.quarterly_job(entries, lines, adj, pos, requested="1998Q3")
    assert q2 == date(1998, 7, 1)
    rows = tables2["month_rows"]
    totals = tables2["month_totals"]
    # month totals add up to the rows; quarter totals add up to the months
    assert rows.agg(F.sum("hours")).first()[0] == totals.agg(F.sum("total_hours")).first()[0]
    assert totals.agg(F.sum("total_bonus")).first()[0] == tables2["quarter_totals"].agg(F.sum("total_bonus")).first()[0]
    cover = tables2["cover_quarter"].first()
    assert cover["total_hours"] == totals.agg(F.sum("total_hours")).first()[0]
    with pytest.raises(ValueError):
        R.quarterly_job(entries, lines, adj, pos, requested="Q1-1990")


def test_transfers_balance_in_report(spark, inputs):
    entries, lines, adj, pos = inputs
    _, t = R.quarterly_job(entries, lines, adj, pos, requested="1998Q3")
    rows = t["month_rows"]
    sent_to_valid = rows.alias("d").join(
        rows.select("staff_name", "proj_norm", "ms_norm", "month").alias("r"),
        (F.col("d.assign_to") == F.col("r.staff_name")) & (F.col("d.proj_norm") == F.col("r.proj_norm"))
        & (F.col("d.ms_norm") == F.col("r.ms_norm")) & (F.col("d.month") == F.col("r.month"))
        & (F.col("d.assign_to") != F.col("d.staff_name")),
    ).agg(F.sum("d.transferable")).first()[0]
    received = rows.agg(F.sum("from_others")).first()[0]
    assert sent_to_valid == received


def test_flat_rate_revenue_bounds(spark, inputs):
    entries, lines, adj, pos = inputs
    _, t = R.quarterly_job(entries, lines, adj, pos, requested="1998Q3")
    bad = t["month_rows"].where((F.col("billing") == "Pauschale") & (F.col("revenue") > F.col("possible") + 1e-9))
    assert bad.count() == 0


def test_dispatch(spark, inputs):
    entries, lines, adj, pos = inputs
    q = R.generate(R.ReportConfig("quarterly", date(1998, 7, 1), date(1998, 9, 30), "month"), entries, lines, adj, pos)
    assert "month_rows" in q and q["cover_months"].count() == 3   # all three months of the quarter
    f = R.generate(R.ReportConfig("custom_period", date(1998, 7, 1), date(1998, 12, 31), "week",
                                  include_budget_overview=False), entries, lines, adj, pos)
    assert set(f) == {"flex_rows", "flex_block_totals", "flex_summary"}
    total = f["flex_summary"].where(F.col("block_name").isNull()).first()["total_hours"]
    assert total == f["flex_rows"].agg(F.sum("hours")).first()[0]
    p = R.generate(R.ReportConfig("project", date(1998, 1, 1), date(1998, 12, 31), projects=["1003"]),
                   entries, lines, adj, pos)
    assert set(r[0] for r in p["project_summary"].select("proj_norm").distinct().collect()) <= {"1003.01 Projekt 3"}
    e = R.generate(R.ReportConfig("employee", date(1998, 1, 1), date(1998, 12, 31), exclude_special_projects=True),
                   entries, lines, adj, pos)
    assert e["employee_summary"].where(F.col("proj_norm").startswith("0000")).count() == 0


def test_employee_filter_keeps_numbers_over_all_staff(spark, inputs):
    entries, lines, adj, pos = inputs
    one = entries.select("staff_name").orderBy("staff_name").first()[0]
    cfg = lambda who: R.ReportConfig("quarterly", date(1998, 7, 1), date(1998, 9, 30), "monthly", employees=who)
    every, own = (R.generate(cfg(who), entries, lines, adj, pos) for who in ([], [one]))
    for name in ("month_rows", "quarter_summary", "month_totals", "quarter_milestones"):
        want = every[name].where(F.col("staff_name") == one)
        cols = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in want.dtypes]
        assert sorted(map(repr, own[name].select(cols).collect())) == sorted(map(repr, want.select(cols).collect()))


def test_flexible_adjustments(spark, inputs):
    entries, lines, adj, pos = inputs
    for grouping in ("monthly", "weekly", "period", "none"):
        cfg = R.ReportConfig("custom_period", date(1998, 7, 1), date(1998, 9, 30), grouping, include_budget_overview=False)
        t = R.generate(cfg, entries, lines, adj, pos)
        rows, totals = t["flex_rows"], t["flex_block_totals"]
        # every adjustment of the range stands on one row, and in the totals
        want = adj.agg(F.sum("adj_h")).first()[0]
        assert rows.agg(F.sum("adj_h")).first()[0] == want
        s = totals.agg(F.sum("adj_regular") + F.sum("adj_special"), F.sum("bonus_total") - F.sum("bonus_base") - F.sum("adj_regular"),
                       F.sum("special_total") - F.sum("special_base") - F.sum("adj_special")).first()
        assert (s[0], s[1], s[2]) == (want, 0, 0)
        assert rows.where(F.col("billing") != "Unbekannt").count() > 0 and "position" in rows.columns


@pytest.mark.parametrize("rows_a_task", [R.ROWS_A_TASK, 40])
def test_flexible_rows_broadcast_nothing_that_grows(spark, inputs, monkeypatch, rows_a_task):
    monkeypatch.setattr(R, "ROWS_A_TASK", rows_a_task)
    entries, lines, adj, _ = inputs
    cfg = R.ReportConfig("custom_period", date(1998, 7, 1), date(1998, 9, 30), "week")
    adj = materialize(adj, "adjustments")
    daily = BK.landed_day_hours(R.filtered_entries(entries, cfg))
    plan, records, pmap, _ = R.budget_of(lines)
    rows = R.flex_rows(daily, plan, cfg, adj, lambda keys: RU.landed_budget(RU.resolve_budget(keys, records, pmap)))
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [staff_name" not in text and text.count("SortMergeJoin [staff_name") >= 3
    assert rows.agg(F.sum("hours")).first()[0] == daily.agg(F.sum("hours")).first()[0]
    assert rows.agg(F.sum("adj_h")).first()[0] == adj.agg(F.sum("adj_h")).first()[0]


def test_revenue_totals_add_up(spark, inputs):
    entries, lines, adj, pos = inputs
    _, t = R.quarterly_job(entries, lines, adj, pos, requested="1998Q3")
    for col in ("revenue", "possible", "lost", "revenue_key"):
        total = lambda name: t[name].agg(F.sum(col)).first()[0]
        assert total("month_revenue_totals") == pytest.approx(total("month_rows"))
        assert total("quarter_revenue_totals") == pytest.approx(total("quarter_summary"))


def test_result_independent_of_partitioning(spark, inputs):
    entries, lines, adj, pos = inputs
    from bonusledger.operators import bookings as BK
    a = sorted(BK.project_summary(entries).collect())
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "3")
        b = sorted(BK.project_summary(entries.repartition(5)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert a == b


def test_snap_range():
    cfg = R.ReportConfig("quarterly", date(2025, 7, 15), date(2025, 9, 10), snap=True)
    assert (cfg.start_date, cfg.end_date) == (date(2025, 7, 1), date(2025, 9, 30))
    assert R.snap_range("monthly", date(2024, 2, 10), date(2024, 2, 11)) == (date(2024, 2, 1), date(2024, 2, 29))
    assert R.snap_range("yearly", date(2024, 5, 1), date(2024, 6, 1)) == (date(2024, 1, 1), date(2024, 12, 31))
    assert R.snap_range("custom_period", date(2024, 5, 3), date(2024, 6, 1)) == (date(2024, 5, 3), date(2024, 6, 1))
