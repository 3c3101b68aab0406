"""Scalar functions against the reference's unit assertions and edge cases."""

from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bonusledger.functions import scalars as S


def one(spark, expr, value, dtype="string"):
    df = spark.createDataFrame([(value,)], f"x {dtype}")
    return df.select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [
    ("8,00", Decimal("8.00")), ("1.234,56", Decimal("1234.56")), ("abc", None), (None, None),
    ("  100 ", Decimal("100.00")), ("-3,5", Decimal("-3.50")),
])
def test_de_number(spark, text, expected):
    assert one(spark, S.de_number, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("• 1.1 Test", "1.1 Test"), ("● Item", "Item"), (None, ""), ("- - Paket", "Paket"), ("  x •y ", "x y"),
])
def test_norm_milestone(spark, text, expected):
    assert one(spark, S.norm_milestone, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("0000 Allgemein", True), ("1234.01 Testprojekt", False), ("", False), (None, False), ("  0000.02 X", True),
])
def test_special_project(spark, text, expected):
    assert one(spark, S.is_special_project, text) is expected


@pytest.mark.parametrize("text,hours,unit", [
    ("Einarbeitung (max. 8h/Monat pro MA)", Decimal("8.00"), "monat"),
    ("Firmenveranstaltungen (max. 4h/Quartal pro MA)", Decimal("4.00"), "quartal"),
    ("1.2 Large (2,5h pro Monat)", Decimal("2.50"), "monat"),
    ("1.5 Small (6 h/Quartal)", Decimal("6.00"), "quartal"),
    ("1.1 Economy", None, None),
])
def test_budget_from_name(spark, text, hours, unit):
    assert one(spark, S.name_budget_hours, text) == hours
    assert one(spark, S.name_budget_unit, text) == unit


@pytest.mark.parametrize("text,expected", [
    ("Tue, 01 Oct 2024 00:00:00 +0200", date(2024, 10, 1)),
    ("Fri, 01 Nov 2024 00:00:00 +0100", date(2024, 11, 1)),
    ("Mo, 05 Mai 2024", date(2024, 1, 5)),       # unknown month token -> January (D18)
    ("Thu, 31 Feb 2024", None),                  # impossible date -> null
    ("no date", None),
])
def test_booking_date(spark, text, expected):
    assert one(spark, S.booking_date, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("8", Decimal("8.00")), ("8.5", Decimal("8.50")), ("8,00", Decimal("0.00")), (None, Decimal("0.00")),
    ("", Decimal("0.00")), (" 2.25 ", Decimal("2.25")),
])
def test_booking_hours(spark, text, expected):
    assert one(spark, S.booking_hours, text) == expected


@pytest.mark.parametrize("text", ["Q3-2025", "Q3/2025", "Q32025", "Q3 2025", "2025Q3", "2025-Q3", "2025/Q3",
                                  "2025 Q3", "q3-2025"])
def test_parse_quarter(spark, text):
    assert S.parse_quarter(text) == date(2025, 7, 1)
    assert one(spark, S.quarter_of_text, text) == date(2025, 7, 1)


def test_parse_quarter_invalid(spark):
    with pytest.raises(ValueError):
        S.parse_quarter("Q5-2025")
    with pytest.raises(ValueError):
        S.parse_quarter("Sommer")
    assert one(spark, S.quarter_of_text, "Q5-2025") is None


def test_billing_type(spark):
    df = spark.createDataFrame([
        ("(p) 1.1 Meilenstein", "X"), ("(aN) 2 Paket", "x "), ("(a.n.) 3", "X"), ("(a n) 4", "X"),
        ("1 Paket", "X"), ("(p) 5", None), ("(p) (an)", "X"),
    ], "pkg string, flag string")
    got = [r[0] for r in df.select(S.billing_type(F.col("pkg"), F.col("flag"))).collect()]
    assert got == ["Pauschale", "Nachweis", "Nachweis", "Nachweis", "Unbekannt", "Unbekannt", "Pauschale"]
    forced = df.select(S.billing_type(F.col("pkg"), F.col("flag"), force=True)).collect()
    assert forced[5][0] == "Pauschale"


def test_status_and_labels(spark):
    df = spark.createDataFrame([(89.99,), (90.0,), (100.0,), (100.01,)], "p double")
    assert [r[0] for r in df.select(S.status_band("p")).collect()] == ["green", "yellow", "yellow", "red"]
    assert one(spark, S.month_label, date(2025, 10, 1), "date") == "Oktober 2025"
    assert one(spark, S.month_label, date(2025, 3, 1), "date") == "März 2025"


def test_project_keys(spark):
    assert one(spark, S.project_keys, " 1234.01 Testprojekt ") == ["1234.01 Testprojekt", "1234.01"]
    assert one(spark, S.project_keys, "0000") == ["0000"]
    assert one(spark, S.project_keys, "") == []


def test_supplement_matches_monat(spark):
    # D11: 'nat' also matches 'Monat'
    assert one(spark, S.is_supplement_package, "(max. 8h/Monat pro MA)") is True
    assert one(spark, S.is_supplement_package, "NAT 01 Zusatz") is True
    assert one(spark, S.is_supplement_package, "1.1 Economy") is False
