"""Landed entries and month hours, accounts of unreadable values, reports per file."""

import os
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from test_sources import document, entry, export

from bonusledger import sinks
from bonusledger.operators import bookings as BK
from bonusledger.plans import reports as R
from bonusledger.sources import bridge as BR
from bonusledger.sources import files, landed

SF = "/root/testdata/sf0.001"


def write(path, *rows):
    path.write_text(document(*rows), encoding="utf-8")
    return str(path)


def test_landing_a_file_recomputes_its_months_only(spark, tmp_path):
    base, hours = str(tmp_path / "entries"), str(tmp_path / "hours")
    a = write(tmp_path / "a.xml", entry(day="Tue, 01 Oct 2024", number="2"), entry(day="Fri, 01 Nov 2024", number="3"))
    b = write(tmp_path / "b.xml", entry(day="Fri, 01 Nov 2024", number="4"), entry(day="Mon, 02 Dec 2024", number="5"))
    assert landed.land(files.read_time_xml(spark, a), base, hours) == [date(2024, 10, 1), date(2024, 11, 1)]
    october = {f: os.stat(f"{hours}/month=2024-10-01/{f}").st_mtime_ns for f in os.listdir(f"{hours}/month=2024-10-01")}
    assert landed.land(files.read_time_xml(spark, b), base, hours) == [date(2024, 11, 1), date(2024, 12, 1)]
    got = lambda: {r["month"].month: r["hours"] for r in spark.read.parquet(hours).collect()}
    assert got() == {10: 2, 11: 7, 12: 5}
    assert october == {f: os.stat(f"{hours}/month=2024-10-01/{f}").st_mtime_ns for f in os.listdir(f"{hours}/month=2024-10-01")}
    # the same file again, without December: nothing is counted twice, and December goes
    write(tmp_path / "b.xml", entry(day="Fri, 01 Nov 2024", number="1"))
    assert landed.land(files.read_time_xml(spark, b), base, hours) == [date(2024, 11, 1), date(2024, 12, 1)]
    assert got() == {10: 2, 11: 4}
    assert landed.read_entries(spark, base).count() == 3


def test_quarters_of_a_landed_table_read_no_file(spark, tmp_path):
    path = str(tmp_path / "e")
    landed.land_entries(files.read_time_xml(spark, write(
        tmp_path / "a.xml", entry(day="Tue, 01 Oct 2024"), entry(day="Mon, 02 Dec 2024"), entry(day="Wed, 01 May 2024"))), path)
    latest = landed.latest_quarter(spark, path)
    plan = latest._jdf.queryExecution().toString()
    assert "FileScan" not in plan and "parquet" not in plan.lower()
    (r,) = latest.collect()
    assert (r["quarter"], r["months"]) == (date(2024, 10, 1), [date(2024, 10, 1), date(2024, 12, 1)])
    assert landed.quarters_available(spark, path).count() == 2
    # P4 prunes months
    scan = BK.in_quarter(landed.read_entries(spark, path), date(2024, 10, 1))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(month" in scan


def test_account_of_time_files(spark, tmp_path):
    a = write(tmp_path / "a.xml", entry(), entry(staff=""), entry(day="Mo, 05 Mai 2025"), entry(number="8,00"), entry(number=""),
              entry(day="Fri, 31 Feb 2025"), entry().replace("work_package_name", "other"), entry().replace('"date"', '"day"'))
    entries, account = files.scan_time_xml(spark, a)
    (r,) = account.collect()
    assert r.asDict() | {"source_file": ""} == {
        "source_file": "", "n_rows": 10 - 2, "n_bookings": 5, "no_cells": 0, "no_staff": 1, "no_package": 1, "no_date": 1,
        "date_unread": 1, "month_unknown": 1, "hours_unread": 1}
    assert entries.count() == 5
    (tmp_path / "b.csv").write_text(export(lines=[["(p) 1", "7001 X", "X", "viel", "1,00"], ["2", "", "", "2,00", "1.0x"]]), encoding="utf-8")
    lines = files.read_budget_csv(spark, str(tmp_path / "b.csv"))
    unread = {x["column"]: x["n_unread"] for x in files.budget_account(lines).collect()}
    assert unread == {"soll_txt": 1, "ist_txt": 1, "budget_txt": 0, "sollhonorar_txt": 0, "billed_txt": 0, "cost_txt": 0}
    positions = spark.createDataFrame([], "staff_name string, position string")
    none = spark.createDataFrame([], "staff_name string, proj_norm string, ms_norm string, month date, adj_h decimal(18,2), assign_to string")
    _, tables = R.quarterly_job(entries, lines, none, positions, account=account)
    assert tables["booking_account"].first()["no_staff"] == 1
    assert tables["budget_account"].where("n_unread > 0").count() == 2


@pytest.fixture(scope="module")
def single_and_joint(spark):
    entries = BR.bookings(spark, SF, files=2)
    lines, positions = BR.budget_lines(spark, SF), BR.positions(spark, SF)
    adjustments = BR.adjustments(spark, SF)
    return entries, lines, adjustments, positions


def rows_of(df, report=None):
    columns = sorted(c for c in df.columns if c != "report")
    df = df if report is None else df.where(F.col("report") == report)
    rounded = lambda v: round(v, 6) if isinstance(v, (float, Decimal)) else v
    return sorted((tuple(map(rounded, r)) for r in df.select(columns).collect()), key=str)


def test_reports_per_file_equal_single_reports(spark, single_and_joint, tmp_path):
    entries, lines, adjustments, positions = single_and_joint
    cfg = R.ReportConfig("custom_period", date(1998, 7, 1), date(1998, 8, 31), "weekly")
    _, joint = R.quarterly_job(R.per_file(entries), lines, adjustments, positions, requested="1998Q3")
    flexible = R.generate(cfg, R.per_file(entries), lines, adjustments, positions)
    one = entries.where("source_file = 'times-1'")
    _, single = R.quarterly_job(one, lines, adjustments, positions, requested="1998Q3")
    for name in ("month_rows", "month_totals", "quarter_summary", "cover_months", "cover_quarter", "employees"):
        assert rows_of(joint[name], "times-1") == rows_of(single[name]), name
    alone = R.generate(cfg, one, lines, adjustments, positions)
    for name in ("flex_rows", "flex_block_totals", "flex_summary"):
        assert rows_of(flexible[name], "times-1") == rows_of(alone[name]), name
    paths = sinks.write_report({k: joint[k] for k in ("month_rows", "month_totals")}, str(tmp_path), "Q3-1998")
    assert sorted(d for d in os.listdir(paths["export"]) if "=" in d) == ["report=times-0", "report=times-1"]


def test_files_have_their_own_latest_quarter(spark, single_and_joint):
    entries, lines, adjustments, positions = single_and_joint
    entries = entries.where("source_file = 'times-0' or quarter <= date'1999-01-01'")
    _, tables = R.quarterly_job(R.per_file(entries), lines, adjustments, positions)
    got = {r["report"]: r["quarter"] for r in tables["cover_quarter"].collect()}
    want = {r["source_file"]: r["q"] for r in entries.groupBy("source_file").agg(F.max("quarter").alias("q")).collect()}
    assert got == want and len(set(got.values())) == 2
