"""Decision table and bonus rules on the guide's worked examples and small cases."""

from decimal import Decimal

from bonusledger.operators import budget as BU
from bonusledger.operators import bookings as BK
from bonusledger.operators import rules as RU

from conftest import entries_df, lines_df


def month_rows(spark, entries, lines):
    return {(r["staff_name"], str(r["month"]), r["ms_norm"]): r
            for r in RU.month_rows(BK.month_hours(entries_df(spark, entries)), BU.plan_actual(lines_df(spark, lines))).collect()}


def test_guide_example_regular_within_budget(spark):
    rows = month_rows(spark,
                      [("Anna", "5678.01 Brandschutzkonzept", "G", "2025-01-15", 40)],
                      [("5678.01 Brandschutzkonzept", None, "-"), (None, None, "G", "100,00", "85,00")])
    r = rows[("Anna", "2025-01-01", "G")]
    assert r["soll"] == Decimal("100.00") and r["ist"] == Decimal("85.00")
    assert r["pct"] == 85.0 and r["eligible"] is True and r["status"] == "green"


def test_guide_example_quarterly_special(spark):
    ms = "Firmenveranstaltungen (max. 4h/Quartal pro MA)"
    rows = month_rows(spark, [
        ("Anna", "0000 Intern", ms, "2024-10-10", 1.5),
        ("Anna", "0000 Intern", ms, "2024-11-10", 1.5),
        ("Anna", "0000 Intern", ms, "2024-12-10", 1.0),
    ], [("0000 Intern", None, "-")])
    got = [rows[("Anna", m, ms)] for m in ("2024-10-01", "2024-11-01", "2024-12-01")]
    assert [r["pct"] for r in got] == [37.5, 75.0, 100.0]
    assert all(r["eligible"] for r in got)
    assert [r["soll"] for r in got] == [Decimal("4.00")] * 3


def test_guide_example_over_budget(spark):
    rows = month_rows(spark,
                      [("Bob", "4321.02 Gutachten", "G", "2025-02-03", 10)],
                      [("4321.02 Gutachten", None, "-"), (None, None, "G", "50,00", "55,00")])
    r = rows[("Bob", "2025-02-01", "G")]
    assert r["pct"] == 110.0 and r["eligible"] is False and r["status"] == "red"


def test_rollback_with_future_hours_of_all_staff(spark):
    # Ist(month) = plan Ist - later months' hours of everyone on the key
    rows = month_rows(spark, [
        ("A", "1000.01 P", "M", "2025-01-05", 4),
        ("B", "1000.01 P", "M", "2025-02-05", 6),
        ("A", "1000.01 P", "M", "2025-03-05", 5),
    ], [("1000.01 P", None, "-"), (None, None, "M", "40,00", "30,00")])
    assert rows[("A", "2025-01-01", "M")]["ist"] == Decimal("19.00")
    assert rows[("B", "2025-02-01", "M")]["ist"] == Decimal("25.00")
    assert rows[("A", "2025-03-01", "M")]["ist"] == Decimal("30.00")


def test_monthly_dictionary_override(spark):
    ms = "Einarbeitung neuer Mitarbeiter (max. 8h/Monat pro MA)"
    rows = month_rows(spark, [("A", "0000 Intern", ms, "2025-01-05", 9)], [("0000 Intern", None, "-")])
    r = rows[("A", "2025-01-01", ms)]
    assert r["soll"] == Decimal("8.00") and r["ist"] == Decimal("9.00") and r["eligible"] is False


def test_transfers_balance(spark):
    e = entries_df(spark, [
        ("A", "1000.01 P", "M", "2025-01-05", 4),
        ("B", "1000.01 P", "M", "2025-01-06", 6),
        ("C", "1000.01 P", "M", "2025-01-07", 2),
    ])
    rows = RU.month_rows(BK.month_hours(e), BU.plan_actual(lines_df(spark, [("1000.01 P", None, "-")])))
    adj = spark.createDataFrame([
        ("A", "1000.01 P", "M", __import__("datetime").date(2025, 1, 1), Decimal("-3.00"), "B"),
        ("C", "1000.01 P", "M", __import__("datetime").date(2025, 1, 1), Decimal("-5.00"), "Z"),  # no row: lost
    ], "staff_name string, proj_norm string, ms_norm string, month date, adj_h decimal(18,2), assign_to string")
    ra = {r["staff_name"]: r for r in RU.with_adjustments(rows, adj).collect()}
    assert ra["A"]["transferable"] == Decimal("3.00")
    assert ra["C"]["transferable"] == Decimal("2.00")       # capped at own hours
    assert ra["B"]["from_others"] == Decimal("3.00")
    tot = {r["staff_name"]: r for r in RU.month_totals(RU.with_adjustments(rows, adj)).collect()}
    assert tot["A"]["bonus_total"] == Decimal("1.00")
    assert tot["B"]["total_bonus"] == Decimal("9.00")
