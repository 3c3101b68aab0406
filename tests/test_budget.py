"""Budget export scans on small hand-written files."""

from decimal import Decimal

import pytest

from bonusledger.operators import budget as BU

from conftest import lines_df


def records(spark, rows):
    return {(r["project"], r["top_norm"]): r for r in BU.budget_records(lines_df(spark, rows)).collect()}


def parents(spark, rows):
    return {(r["project_key"], r["ms_norm"]): r["parents"] for r in BU.parent_map(lines_df(spark, rows)).collect()}


BASE = [
    ("1234.01 Testprojekt", None, "-"),
    (None, "X", "(p) 1.1 Testmeilenstein", "100,00", None, None, "10.000,00"),
    (None, None, "• 1.1.1 Unterpaket", "50,00", "20,00"),
    (None, None, "'   SV", "10,00", None, "900,00"),
    (None, None, "'   CAD", "0,00", None, "700,00"),
    (None, None, "'   CAD", "10,00", None, "650,00"),
    (None, None, "NAT 01 Zusatz", "8,00", None, "400,00"),
]


def test_records_rates_and_supplement(spark):
    rec = records(spark, BASE)
    main = rec[("1234.01 Testprojekt", "(p) 1.1 Testmeilenstein")]
    assert main["billing"] == "Pauschale"
    assert main["target_hours"] == Decimal("78.00")   # 50 + 10 + 10 + 8 (positive sub-rows)
    assert main["rate_sv"] == 90.0
    assert main["rate_cad"] == 65.0                    # last matching row with hours wins
    assert main["rate_adm"] == 100.0                   # Pauschale default: 10000 / 100
    nat = rec[("1234.01 Testprojekt", "NAT 01 Zusatz")]
    assert nat["billing"] == "Pauschale"               # inherits the parent's billing
    assert nat["rate_sv"] == 50.0
    assert nat["lookup_id"] == 1 and main["lookup_id"] == 2   # supplements are emitted first


def test_parent_map_keys_and_self_parent(spark):
    pm = parents(spark, BASE)
    assert pm[("1234.01 Testprojekt", "1.1.1 Unterpaket")] == ["(p) 1.1 Testmeilenstein"]
    assert pm[("1234.01", "1.1.1 Unterpaket")] == ["(p) 1.1 Testmeilenstein"]
    # a supplement is its own parent next to the section's parent: two parents
    assert pm[("1234.01", "NAT 01 Zusatz")] == ["(p) 1.1 Testmeilenstein", "NAT 01 Zusatz"]


@pytest.mark.parametrize("n", [79, 85, 200])
def test_long_sections_count_whole(spark, n):
    rows = [("P1 Proj", None, "-"), (None, "X", "(aN) Top", "1,00")]
    rows += [(None, None, f"• sub {i}", "1,00") for i in range(n)]
    rows += [(None, None, "'   SV", "10,00", None, "900,00"), (None, None, "NAT 9 Extra", "2,00", None, "50,00"),
             (None, "X", "(aN) Next", "1,00")]
    rec = records(spark, rows)
    top = rec[("P1 Proj", "(aN) Top")]
    assert (top["target_hours"], top["rate_sv"]) == (Decimal(n + 12), 90.0)
    ids = [rec[("P1 Proj", m)]["lookup_id"] for m in ("NAT 9 Extra", "(aN) Top", "(aN) Next")]
    assert ids == [1, 2, 3]
    limited = BU.budget_records_of(BU.prepare(lines_df(spark, rows), lookahead=79))
    assert {r["top_norm"]: r for r in limited.collect()}["(aN) Top"]["target_hours"] == Decimal(79 if n >= 79 else n)


def test_ids_go_on_over_files(spark):
    rows = [("P1 Proj", None, "-"), (None, "X", "(aN) Top", "1,00"), (None, "X", "(aN) Next", "1,00")]
    two = lines_df(spark, rows, "mem/a.csv").union(lines_df(spark, rows, "mem/b.csv"))
    got = sorted((r["lookup_id"], r["file_path"], r["top_norm"]) for r in BU.budget_records(two).collect())
    assert [x[0] for x in got] == [1, 2, 3, 4] and [x[1] for x in got] == ["mem/a.csv"] * 2 + ["mem/b.csv"] * 2


def test_section_crosses_project_change(spark):
    # The section scan runs past a project change; the parent run does not
    rows = [
        ("A proj", None, "-"),
        (None, "X", "Top A", "5,00"),
        ("B proj", None, "• 2.1 foreign", "7,00"),
    ]
    rec = records(spark, rows)
    assert rec[("A proj", "Top A")]["target_hours"] == Decimal("7.00")
    pm = parents(spark, rows)
    assert ("B proj", "2.1 foreign") not in pm


def test_dash_resets_parent_and_plan(spark):
    rows = [
        ("A proj", None, "-"),
        (None, "X", "Top", "5,00", "1,00"),
        (None, None, "-"),
        (None, None, "• after dash", "2,00", "3,00"),
    ]
    pm = parents(spark, rows)
    assert ("A proj", "after dash") not in pm
    plan = {(r["proj_norm"], r["ms_norm"]): r for r in BU.plan_actual(lines_df(spark, rows)).collect()}
    assert plan[("A proj", "after dash")]["soll"] == Decimal("2.00")
    assert plan[("A proj", "Top")]["pct"] == 20.0


def test_overview_status(spark):
    ov = {r["top_milestone"]: r for r in BU.budget_overview(BU.budget_records(lines_df(spark, [
        ("A proj", None, "-"),
        (None, "X", "1 Paket", "5,00"),
        (None, "X", "(aN) 2 Paket", "5,00"),
        (None, None, "'   SV", "10,00", None, "900,00"),
    ]))).collect()}
    assert ov["1 Paket"]["status"].endswith("Manual erforderlich")
    assert ov["1 Paket"]["remark"] == "Abrechnungsart wählen; Stundensätze eingeben"
    assert ov["(aN) 2 Paket"]["status"].endswith("Vollständig")


def test_resolution_cascade(spark):
    """J3 / J4 by hand: Alpha and Beta share the code 1234.01 and the top
    milestone name; the id map keeps only code keys, later records win (D6)."""
    from bonusledger.operators import rules as RU

    lines = lines_df(spark, [
        ("1234.01 Alpha", None, "-"),
        (None, "X", "(p) 1 Top", "10,00", None, None, "1.000,00"),
        (None, None, "• 1.1 Sub", "5,00"),
        (None, None, "NAT 01 Extra", "8,00", None, "400,00"),
        ("1234.01 Beta", None, "-"),
        (None, "X", "(p) 1 Top", "20,00", None, None, "2.000,00"),
    ])
    recs, edges = BU.budget_scan(lines)
    ids = {(r["project"], r["top_norm"]): r["lookup_id"] for r in recs.collect()}
    assert ids == {("1234.01 Alpha", "NAT 01 Extra"): 1, ("1234.01 Alpha", "(p) 1 Top"): 2,
                   ("1234.01 Beta", "(p) 1 Top"): 3}
    keys = spark.createDataFrame([
        ("1234.01 Alpha", "(p) 1 Top"), ("1234.01 Alpha", "1.1 Sub"), ("1234.01 Alpha", "NAT 01 Extra"),
        ("1234.01", "(p) 1 Top"), ("9999 X", "foo"),
    ], "proj_norm string, ms_norm string")
    res = {(r["proj_norm"], r["ms_norm"]): r
           for r in RU.resolve_budget(keys, recs, BU.parent_map_from_edges(edges)).collect()}
    a = res[("1234.01 Alpha", "(p) 1 Top")]
    assert (a["res_id"], a["lookup_id"]) == (2, 3)          # J3 by full name, J4 by code -> Beta
    b = res[("1234.01 Alpha", "1.1 Sub")]
    assert (b["res_id"], b["lookup_id"]) == (2, 3)          # single parent; fallback through the code key
    assert b["target_hours_q"] == Decimal("13.00")          # Alpha's target: 5 + 8 from its sub-rows
    c = res[("1234.01 Alpha", "NAT 01 Extra")]
    assert (c["res_id"], c["lookup_id"], c["billing"]) == (1, 1, "Pauschale")   # two parents: exact only
    d = res[("1234.01", "(p) 1 Top")]
    assert (d["res_id"], d["lookup_id"]) == (3, 3)
    e = res[("9999 X", "foo")]
    assert (e["res_id"], e["lookup_id"], e["billing"]) == (None, None, "Unbekannt")
