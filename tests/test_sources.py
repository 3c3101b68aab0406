"""File scans: budget exports (encodings, headers, several files) and time exports
(encodings, entities, CDATA, end tags, rows that are no XML)."""

import csv
import io
import random
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from bonusledger.sources import files

HEAD = ["Arbeitspaket", "Projekte", "Honorarbereich", "Iststunden", "Sollstunden Budget"]
LINES = [
    ["(p) 4 Brücke", "7001 Nordhafen", "X", "", "80,00"],
    ["• 4.1 Pfähle", "", "", "2,25", "30,00"],
]


def export(head=HEAD, lines=LINES, eol="\n"):
    return eol.join("\t".join(x) for x in [head, *lines]) + eol


def budget(spark, *paths, **options):
    rows = files.read_budget_csv(spark, [str(p) for p in paths], **options).collect()
    return sorted(rows, key=lambda r: (r["file_path"], r["row_no"]))


@pytest.mark.parametrize("codec", ["utf-16", "utf-8-sig", "utf-8", "cp1252"])
@pytest.mark.parametrize("eol", ["\n", "\r\n"])
def test_budget_encodings(spark, tmp_path, codec, eol):
    p = tmp_path / "b.csv"
    p.write_bytes(export(eol=eol).encode(codec))
    a, b = budget(spark, p)
    assert (a["projekte"], a["flag"], a["package"], a["soll_txt"], a["ist_txt"]) == ("7001 Nordhafen", "X", "(p) 4 Brücke", "80,00", None)
    assert (b["projekte"], b["package"], b["soll_txt"], b["ist_txt"], b["budget_txt"]) == (None, "• 4.1 Pfähle", "30,00", "2,25", None)


def test_budget_files_have_headers_of_their_own(spark, tmp_path):
    order = [4, 2, 0, 1, 3]
    other = export([HEAD[i] for i in order], [[x[i] for i in order] for x in LINES])
    (tmp_path / "a.csv").write_bytes(export().encode("utf-8"))
    (tmp_path / "b.csv").write_bytes(other.encode("utf-16"))
    (tmp_path / "c.csv").write_bytes(other.replace("Projekte", "﻿Project ").encode("cp1252", "ignore"))
    rows = budget(spark, tmp_path / "a.csv", tmp_path / "b.csv", tmp_path / "c.csv")
    assert len(rows) == 6
    for r in rows[::2]:
        assert (r["projekte"], r["soll_txt"], r["ist_txt"], r["package"]) == ("7001 Nordhafen", "80,00", None, "(p) 4 Brücke")


def test_budget_lines_keep_their_order_over_splits(spark, tmp_path):
    p = tmp_path / "long.csv"
    p.write_text(export(lines=[[f"• {i}", "", "", "", str(i)] for i in range(20000)]), encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
        rows = budget(spark, p)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r["soll_txt"] for r in rows] == [str(i) for i in range(20000)]


def test_budget_quoted_field_over_lines(spark, tmp_path):
    p = tmp_path / "q.csv"
    p.write_text(export(lines=[['"two\nlines"', "7001 X", "X", "", "1,00"]]), encoding="utf-8")
    (r,) = budget(spark, p, multiline=True)
    assert r["package"] == "two\nlines"


def test_budget_header_errors_name_the_column(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text(export(["Arbeitspaket", "Foo", "Honorarbereich", "Bar", "Sollstunden Budget"]), encoding="utf-8")
    with pytest.raises(ValueError, match="Projekte, Iststunden"):
        files.read_budget_csv(spark, str(p))


def test_budget_source(spark, tmp_path):
    (tmp_path / "central.csv").write_text(export(lines=LINES[:1]), encoding="utf-8")
    (tmp_path / "own.csv").write_text(export(), encoding="utf-8")
    assert files.budget_source(spark, None, str(tmp_path / "central.csv")).count() == 1
    assert files.budget_source(spark, str(tmp_path / "own.csv"), str(tmp_path / "central.csv")).count() == 2


def entry(staff="Ada Müller", package="3.1 Statik", day="Wed, 12 Feb 2025", number="1.5", purpose="p", end="</row>"):
    cells = {"purpose": purpose, "number": number, "staff_name": staff, "project": "7001 Nordhafen",
             "work_package_name": package, "date": f"{day} 00:00:00 +0100"}
    return "<row n='1'>" + "".join(f'<cell type="t" name="{k}">{v}</cell>' for k, v in cells.items()) + end


def document(*rows, encoding="UTF-8", declared=""):
    return (f'<?xml version="1.0" encoding="{encoding}"?>\n<!DOCTYPE report [{declared}]>\n'
            f'<report><rows>{"".join(rows)}<row/><row /><rowcount>2</rowcount></rows></report>')


def booked(spark, tmp_path, text, codec="utf-8"):
    p = tmp_path / "times.xml"
    p.write_bytes(text.encode(codec))
    return files.read_time_xml(spark, str(p)).collect()


def test_time_rows(spark, tmp_path):
    rows = booked(spark, tmp_path, document(entry(), entry(staff=" "), entry(number="0.3333333"), entry(number="1e20"), entry(number="x")))
    assert [r["hours"] for r in rows] == [Decimal("1.5"), Decimal("0.3333333"), Decimal(10) ** 20, 0]
    r = rows[0]
    assert (r["staff_name"], r["booked_on"], r["quarter"], r["proj_norm"], r["ms_norm"], r["month_unknown"]) == (
        "Ada Müller", date(2025, 2, 12), date(2025, 1, 1), "7001 Nordhafen", "3.1 Statik", False)
    assert r["source_file"].endswith("times.xml")


@pytest.mark.parametrize(("name", "codec"), [("ISO-8859-1", "latin-1"), ("UTF-16", "utf-16"), ("windows-1252", "cp1252"), ("UTF-8", "utf-8-sig")])
def test_time_encodings(spark, tmp_path, name, codec):
    (r,) = booked(spark, tmp_path, document(entry(), encoding=name), codec)
    assert r["staff_name"] == "Ada Müller"


def test_time_unknown_encoding_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="XML encoding not supported"):
        booked(spark, tmp_path, document(entry(), encoding="KOI8-R"))


def test_time_markup(spark, tmp_path):
    declared = '<!ENTITY ndash "&#8211;"><!ENTITY co \'Bau &amp; Co\'>'
    rows = booked(spark, tmp_path, document(
        entry(purpose="a &ndash; b &shy;&nbsp;&co; &lt;"), entry(purpose="<![CDATA[x <row> </row> & y]]>"), "<!-- <row>no</row> -->",
        entry(end="</row >"), entry(purpose="second\nline"), declared=declared))
    assert [r["purpose"] for r in rows] == ["a – b ­ Bau & Co <", "x <row> </row> & y", "p", "second\nline"]


def test_time_row_that_is_no_xml_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="row that is not XML"):
        booked(spark, tmp_path, document(entry(), entry(purpose="&unknown;")))


def test_time_last_of_a_repeated_cell_wins(spark, tmp_path):
    row = entry().replace("</row>", '<cell name="number">2.5</cell></row>')
    assert booked(spark, tmp_path, document(row))[0]["hours"] == Decimal("2.5")


def test_time_files_are_merged(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"t{i}.xml").write_text(document(entry(staff=f"S{i}")), encoding="utf-8")
    df = files.read_time_xml(spark, [str(tmp_path / f"t{i}.xml") for i in range(3)])
    assert sorted(r["staff_name"] for r in df.collect()) == ["S0", "S1", "S2"]
    with pytest.raises(ValueError, match="no booking"):
        files.require_rows(df.limit(0))


def test_time_unknown_month_is_january(spark, tmp_path):
    (r,) = booked(spark, tmp_path, document(entry(day="Mo, 05 Mai 2025")))
    assert (r["booked_on"], r["month_unknown"]) == (date(2025, 1, 5), True)


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def quoted_lines(n, odd):
    """Lines with quoted fields over lines, doubled quotes, tabs in quotes, inch marks
    that are no quotes, and quotes that only end in a later line."""
    r = random.Random(n)
    out = []
    for i in range(n):
        kind = r.choice(["plain", "plain", "many", "one", "inch", "double", "empty"])
        value = {"plain": f"• {i}{odd}", "many": f'a{i}\n{odd}"x"\t\n\n b', "one": f"{odd} {i}", "inch": f'5" {i}',
                 "double": f'""{i}"', "empty": f"{i}\n"}[kind]
        written = value if kind in ("plain", "inch") else '"' + value.replace('"', '""') + '"'
        out.append((value, [written, f"7001 P{i}", "X", f'{i}"', str(i)]))
    return out


@pytest.mark.parametrize(("codec", "odd"), [("utf-8", "ö"), ("utf-16", "ਊ਍Ċ"), ("cp1252", "ö"), ("utf-16-be", "ਊĊ਀")])
def test_budget_quotes_over_splits(spark, tmp_path, small_splits, codec, odd):
    """As a parser of whole files reads them, whatever the splits."""
    lines = quoted_lines(300, odd)
    text = export(lines=[x for _, x in lines], eol="\r\n")
    raw = text.encode(codec)
    (tmp_path / "q.csv").write_bytes(("﻿".encode(codec) if codec == "utf-16-be" else b"") + raw)
    (tmp_path / "r.csv").write_bytes(export().encode("utf-8"))
    rows = budget(spark, tmp_path / "q.csv", tmp_path / "r.csv")
    got = [r for r in rows if r["file_path"].endswith("q.csv")]
    want = list(csv.reader(io.StringIO(text.replace("\r\n", "\n"), newline=""), delimiter="\t"))[1:]
    assert [[r["package"], r["projekte"], r["flag"], r["ist_txt"], r["soll_txt"]] for r in got] == want
    assert [r["package"] for r in got] == [v for v, _ in lines]
    assert len(rows) == len(got) + 2
    assert spark.read.text(str(tmp_path / "q.csv")).rdd.getNumPartitions() > 5


def test_budget_files_of_any_width(spark, tmp_path):
    wide = [f"x{i}" for i in range(3000)]
    lines = [[*x, *["y"] * 3000, "1.000,00", "7,00"] for x in LINES]
    (tmp_path / "w.csv").write_text(export([*HEAD, *wide, "Istkosten", "Budget"], lines), encoding="utf-8")
    a, b = budget(spark, tmp_path / "w.csv")
    assert (a["cost_txt"], b["cost_txt"], b["budget_txt"], a["billed_txt"]) == ("1.000,00", "1.000,00", "7,00", None)


def test_budget_lines_may_end_in_carriage_returns(spark, tmp_path):
    (tmp_path / "c.csv").write_bytes(export(eol="\r").encode("utf-16"))
    assert [(r["row_no"], r["package"]) for r in budget(spark, tmp_path / "c.csv")] == [(2, "(p) 4 Brücke"), (3, "• 4.1 Pfähle")]


def test_rows_are_spared_needless_passes(spark):
    """What has no CDATA, comment or white space at its ends is not rewritten, and a
    document's prolog is looked for once; odd texts read as before."""
    text = F.col("t")
    assert str(files.declared_entities(text)).count("DOCTYPE") == 1 and "contains" in str(files._plain_cdata(text))
    values = ["x", "", " ", "a b", " a ", "\u00a0x\u2003", "x\u0085", "\n1\n", "ö", " ö", "<![CDATA[ a<b ]]>", "a<!-- b -->c", "<!-- b -->", "&e;&f;&lt;"]
    rows = [(f"<!DOCTYPE x [<!ENTITY e '1'> <!ENTITY f \"<b/>2\" >]><d>{v}</d>", f'<cell name="v">{v}</cell>') for v in values]
    d = spark.createDataFrame(rows, "t string, body string").select(
        F.lit("f").alias("source_file"), files.declared_entities(text).alias("declared"), files._plain_cdata(F.col("body")).alias("body"))
    assert [r["cells"]["v"] for r in files.row_cells(d).collect()] == [
        "x", "", "", "a b", "a", "x", "x", "1", "ö", "ö", "a<b", "ac", "", "2<"]
    assert [tuple(e) for e in d.first()["declared"]] == [("e", "1"), ("f", "<b/>2")]
