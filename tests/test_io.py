"""Sinks and the streaming landing on generated files."""

import csv
import os

import pytest
from pyspark.sql import functions as F

from bonusledger import sinks
from bonusledger.streaming import landing
from test_sources import document, entry


def test_stream_landing_available_now(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for i in range(2):
        (src / f"t{i}.xml").write_text(document(
            entry(staff=f"S{i}", day="Tue, 01 Oct 2024", number="2"), entry(staff=f"S{i}", day="Fri, 01 Nov 2024", number="3")),
            encoding="utf-8")
    target, ckpt = str(tmp_path / "landed"), str(tmp_path / "ckpt")
    q = landing.start_landing(spark, str(src), target, ckpt)
    q.awaitTermination(120)
    landed = spark.read.parquet(target)
    assert landed.count() == 4
    assert sorted(r[0].isoformat() for r in landed.select("month").distinct().collect()) == ["2024-10-01", "2024-11-01"]
    # a second run with no new files adds nothing
    q = landing.start_landing(spark, str(src), target, ckpt)
    q.awaitTermination(120)
    assert spark.read.parquet(target).count() == 4


def test_employee_export_and_report_write(spark, tmp_path):
    from conftest import entries_df, lines_df
    from bonusledger.operators import budget as BU
    from bonusledger.operators import bookings as BK
    from bonusledger.operators import rules as RU

    e = entries_df(spark, [("A", "1000.01 P", "M", "2025-01-05", 4), ("B", "1000.01 P", "M", "2025-01-06", 6)])
    rows = RU.month_rows(BK.month_hours(e), BU.plan_actual(lines_df(spark, [("1000.01 P", None, "-")])))
    out = str(tmp_path / "export")
    sinks.write_employee_export(rows, out)
    assert sorted(d for d in os.listdir(out) if d.startswith("staff_name=")) == ["staff_name=A", "staff_name=B"]
    back = spark.read.option("header", True).csv(out)
    assert back.count() == 2 and "Bonus-Anpassung (h)" in back.columns
    totals = rows.groupBy("staff_name", "month").agg(F.sum("hours").alias("total_hours"), F.sum("hours").alias("bonus_total"),
                                                     F.lit(0).alias("special_total"))
    paths = sinks.write_report({"month_rows": rows, "month_totals": totals, "cover": rows.groupBy("month").agg(F.sum("hours"))},
                               str(tmp_path / "rep"), "Q1-2025")
    assert spark.read.parquet(paths["cover"]).count() == 1
    # K2: sum and bonus lines follow the rows of a month
    (name,) = [f for f in os.listdir(f"{paths['export']}/staff_name=A") if f.endswith(".csv")]
    lines = open(f"{paths['export']}/staff_name=A/{name}", encoding="utf-8").read().splitlines()
    assert [x.split(",")[2] for x in lines[1:]] == ["M", "Summe", "Bonusberechtigte Stunden", "Bonusberechtigte Stunden Sonderprojekt"]


def files_of(folder):
    """Data files in the order of their names."""
    return sorted(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith((".parquet", ".csv")))


def test_detail_files_are_cut_by_measured_sizes(spark, tmp_path):
    """An employee with most of the rows has several files, in order and within the
    bound; small employees share tasks."""
    from datetime import date

    data = [("Big", date(2025, 1 + i % 3, 1), f"P{(i * 7) % 1009:04}", f"M{i // 1009}") for i in range(3000)]
    data += [(f"S{i % 60:02}", date(2025, 1 + i % 3, 1), f"P{(i * 7) % 11:04}", f"M{i}") for i in range(420)]
    rows = spark.createDataFrame(data, "staff_name string, month date, proj_norm string, ms_norm string").repartition(8)
    out = str(tmp_path / "detail")
    sinks.write_employee_detail(rows, out, rows_per_file=500)
    parts = [spark.read.parquet(f).collect() for f in files_of(f"{out}/staff_name=Big")]
    got = [(r["month"], r["proj_norm"], r["ms_norm"]) for p in parts for r in p]
    assert len(got) == 3000 and got == sorted(got)
    assert 6 <= len(parts) <= 9 and max(map(len, parts)) <= 500
    small = [f for i in range(60) for f in files_of(f"{out}/staff_name=S{i:02}")]
    assert len(small) <= 62 and len({os.path.basename(f).split("-")[1] for f in small}) <= 3
    got = [(r["month"], r["proj_norm"]) for r in spark.read.parquet(files_of(f"{out}/staff_name=S07")[0]).collect()]
    assert len(got) == 7 and got == sorted(got)
    sinks.write_employee_detail(rows.limit(0), str(tmp_path / "none"))
    sinks.write_table(rows, str(tmp_path / "t"), order=["staff_name", "month"])
    got = [(r["staff_name"], r["month"]) for f in files_of(str(tmp_path / "t")) for r in spark.read.parquet(f).collect()]
    assert len(got) == 3420 and got == sorted(got)


def test_notes_reach_the_sheets(spark, tmp_path):
    from datetime import date

    month = date(2025, 1, 1)
    rows = spark.createDataFrame([("A", month, "P", "M", 4), ("A", month, "P", "N", 2), ("B", month, "P", "M", 1)],
                                 "staff_name string, month date, proj_norm string, ms_norm string, hours int").withColumns({
                                     c: F.lit(None).cast("string") for c in ("soll", "ist", "pct")})
    notes = spark.createDataFrame([("A", "P", "M", month, "SR", "look"), ("A", "P", "M", month, None, "again"), ("C", "P", "M", month, "AZ", None)],
                                  "staff_name string, proj_norm string, ms_norm string, month date, invoice string, comment string")
    paths = sinks.write_report({"month_rows": rows}, str(tmp_path), "Q1-2025", notes=notes)
    back = {(r["staff_name"], r["Meilenstein"]): (r["Rechnung"], r["Kommentar"])
            for r in spark.read.option("header", True).csv(paths["export"]).collect()}
    assert back == {("A", "M"): ("SR", "look"), ("A", "N"): (None, None), ("B", "M"): (None, None)}
    assert spark.read.parquet(paths["month_rows"]).where("invoice = 'SR'").count() == 1


def test_flexible_report_has_sheets_per_employee(spark, tmp_path):
    """The ten columns of a block's rows, then its sum and bonus lines."""
    from datetime import date

    from conftest import entries_df, lines_df
    from bonusledger.plans import reports as R

    entries = entries_df(spark, [("A", "1000.01 P", "M", "2025-01-07", 4), ("A", "0000 Intern", "N", "2025-01-08", 2),
                                 ("A", "1000.01 P", "M", "2025-01-14", 1), ("B", "1000.01 P", "M", "2025-01-07", 3)])
    lines = lines_df(spark, [("1000.01 P", None, "-"), (None, "X", "(p) 1 Top"), (None, None, "M", "10,00", "5,00")])
    adj = spark.createDataFrame([("A", "1000.01 P", "M", date(2025, 1, 1), 1)],
                                "staff_name string, proj_norm string, ms_norm string, month date, adj_h int").selectExpr(
        "*", "cast(null as string) as assign_to")
    pos = spark.createDataFrame([("A", "SV")], "staff_name string, position string")
    cfg = R.ReportConfig("custom_period", date(2025, 1, 1), date(2025, 1, 31), "weekly")
    notes = spark.createDataFrame([("A", "1000.01 P", "M", date(2025, 1, 14), "AZ", "ok")],
                                  "staff_name string, proj_norm string, ms_norm string, block_start date, invoice string, comment string")
    tables = R.generate(cfg, entries, lines, adj, pos)
    paths = sinks.write_report(tables, str(tmp_path), R.report_name(cfg), notes=notes)
    (name,) = files_of(f"{paths['export']}/staff_name=A")
    head, *got = csv.reader(open(name, encoding="utf-8"))
    assert head[2:] == ["Projekt", "Meilenstein", "Soll (h)", "Ist (h)", "Stunden in Block (h)", "%", "Bonus-Anpassung (h)",
                        "Abrechnungsart", "Rechnung", "Kommentar"]
    assert [(g[0], g[3], float(g[6]), g[8], g[10]) for g in got] == [
        ("2025-01-07", "N", 2.0, "", ""), ("2025-01-07", "M", 4.0, "", ""), ("2025-01-07", "Summe", 6.0, "", ""),
        ("2025-01-07", "Bonusberechtigte Stunden", 4.0, "", ""), ("2025-01-07", "Bonusberechtigte Stunden Sonderprojekt", 2.0, "", ""),
        ("2025-01-14", "M", 1.0, "1.00", "AZ"), ("2025-01-14", "Summe", 1.0, "", ""),
        ("2025-01-14", "Bonusberechtigte Stunden", 2.0, "", ""), ("2025-01-14", "Bonusberechtigte Stunden Sonderprojekt", 0.0, "", "")]
    assert sorted(d for d in os.listdir(paths["flex_rows"]) if "=" in d) == ["staff_name=A", "staff_name=B"]
    with pytest.raises(ValueError, match="no booking"):
        R.generate(cfg, entries.limit(0), lines, adj, pos)
    with pytest.raises(ValueError, match="no booking"):
        R.quarterly_job(entries.limit(0), lines, adj, pos)


def test_landed_tables_are_in_one_folder_that_cleanup_removes(spark):
    from bonusledger import session

    t = session.materialize(spark.range(3).toDF("x"), "probe")
    assert t.count() == 3 and session.run_folder(spark) in t.inputFiles()[0]
    path = session.run_folder(spark).removeprefix("file://")
    assert os.path.isdir(path) and session.cleanup(spark) and not os.path.isdir(path)


def test_sheets_are_written_and_read_in_batches(spark, tmp_path):
    """Not more than so many folders reach the driver at once: a write and a listing
    for every few employees; all rows are there, in order, with names of any kind."""
    from datetime import date

    names = [*(f"S{i:02}" for i in range(23)), "007", "ä#% {x}=/:?*[^]'\"\\y", "Big"]
    data = [(n, date(2025, 1 + i % 3, 1), f"P{(i * 7) % 101:03}", f"M{i}") for n in names for i in range(700 if n == "Big" else 7)]
    rows = spark.createDataFrame(data, "staff_name string, month date, proj_norm string, ms_norm string").repartition(5)
    for kind in ("soll", "ist", "hours", "pct"):
        rows = rows.withColumn(kind, F.lit(1))
    frames, sheets = sinks.in_files(sinks.export_rows(rows), "month", "Projekt", "Meilenstein", rows_per_file=50, folders=4)
    sizes = [(d.select("staff_name").distinct().count(), d.count(), d.rdd.getNumPartitions()) for d in frames]
    assert sum(s[0] for s in sizes) == len(names) and max(s[0] for s in sizes) <= 4 and len(sizes) == 7
    assert sum(s[1] for s in sizes) == len(data) and max(s[2] for s in sizes) <= 2  # small files share a task
    out = str(tmp_path / "export")
    sheets = sinks.write_employee_export(rows, out, rows_per_file=50, folders=4)
    assert len([d for d in os.listdir(out) if d.startswith("staff_name=")]) == len(names)
    assert sorted(sinks.folder_of(staff_name=n) for n in names) == sorted(d for d in os.listdir(out) if d.startswith("staff_name="))
    assert len(files_of(f"{out}/staff_name=Big")) == 14
    columns = ", ".join(f"`{c}` string" for c in ("month", *(c for _, c in sinks.EXPORT_COLUMNS)))
    back = sinks.read_sheets(spark, out, sheets, "csv", columns).orderBy("file_name", "file_block_start", "at").collect()
    for name in names:
        got = [(r["month"], r["Projekt"], r["Meilenstein"]) for r in back if r["staff_name"] == name]
        assert got == sorted((str(m), p, s) for n, m, p, s in data if n == name), name
    before = sorted(os.listdir(out))
    sinks.write_employee_export(rows, out, mode="ignore", rows_per_file=50, folders=4)
    assert sorted(os.listdir(out)) == before and len(files_of(f"{out}/staff_name=Big")) == 14
