"""Rows of nothing but cells are read without the XML parser; what they give is what
the parser gives, and what is no such row is left to it."""

import random

import pytest
from pyspark.sql import functions as F
from test_sources import document, entry

from bonusledger.sources import files, xml_scan

DECLARED = [("ndash", "&#8211;"), ("word", "a b"), ("tag", "<b/>"), ("lone", "x & y")]
TEXTS = ["", " ", "x", " ö 日本 ", "a\n b\t", " x ", "&amp;", "&lt;&gt;&quot;&apos;", "&#65;&#x1F600;", "&ndash;", "&shy;x&nbsp;", "&word;",
         "<![CDATA[a <row> & </row> &ndash; ]] ]]>", "<![CDATA[]]>x<![CDATA[y ]]>", "a > b", "null", "5]]", "'\"",
         # left to the parser
         "&tag;", "<i>x</i>", "a<!-- c -->b", "<?p q?>x"]
ODD = ["&#0;", "&none;", "]]>", "&lone;", "a & b", "\x01", "&amp", "￾", "</cell><cell>", "&#xD800;"]
TAGS = ['name="{}"', "name = '{}'", 'type="text" name="{}"', 'name="{}" a.b-c="x>y"', 'name="{}" Name2="z"']


def bodies(r, n, texts):
    out = []
    for _ in range(n):
        cells = "".join(f"<cell {r.choice(TAGS).format(r.choice(['a', 'b', 'staff_name', 'ü']))}>{r.choice(texts)}</cell>{r.choice(['', ' ', chr(10)])}"
                        for _ in range(r.randint(1, 4)))
        out.append(r.choice(["", " ", "\n"]) + cells + r.choice(["", "", "<group>\n</group>", "<g>x</g>\n", "<cell name='e'/>"]))
    return out


def parsed(spark, texts):
    rows = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source_file string, body string")
    declared = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in DECLARED])
    rows = rows.select("source_file", files._plain_cdata(F.col("body")).alias("body"), declared.alias("declared"))
    return {int(x["source_file"]): x["cells"] for x in files.row_cells(rows).collect()}


KNOWN = [*DECLARED, *files.DTD_ENTITIES.items()]


def test_cells_are_those_of_the_parser(spark):
    texts = bodies(random.Random(5), 600, TEXTS)
    want = parsed(spark, texts)
    got = {i: c for i, t in enumerate(texts) if (c := xml_scan.plain_cells(t, KNOWN)) is not None}
    assert len(got) > 200 and got == {i: want[i] for i in got}


def test_odd_rows_are_left_to_the_parser():
    for odd in [*ODD, *TEXTS[-4:]]:
        assert xml_scan.plain_cells(f'<cell name="a">x</cell><cell name="b">{odd}</cell>', KNOWN) is None, odd
    for body in ['<cell>x</cell>', '<cell name="a" name="b">x</cell>', '<cell name="a" Name="b">x</cell>', '<cell name="a" value="b">x</cell>',
                 '<cell name="a&amp;">x</cell>', '<cell name=a>x</cell>', 'x<cell name="a">x</cell>', '<Cell name="a">x</Cell>', '<cell name="a"/>',
                 '<cell name="a">x</cell><Cell>y</Cell>', '<cell name="a">x', "", " ", "<group></group>", '<cell name="a">x</cell><g><h/></g>']:
        assert xml_scan.plain_cells(body, KNOWN) is None, body


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_files_are_read_by_rows_where_they_hold_them(spark, tmp_path, small_splits):
    """Rows, a document that ends with one, one without any, one in UTF-16 and one of
    another writing of the end tag; comments and CDATA over borders of blocks."""
    rows = [entry(staff=f"S{i}", purpose="<![CDATA[</row><row> " + "x" * (i % 90) + "]]>") + ("<!-- <row>a</row> -->" if i % 3 else "")
            for i in range(150)]
    inner = "".join(entry(staff=f"I{i}") for i in range(5))
    (tmp_path / "a.xml").write_text("﻿" + document(*rows), encoding="utf-8")
    (tmp_path / "b.xml").write_text(f"<row>{inner}</row>")
    (tmp_path / "c.xml").write_text("<data><!-- " + "y" * 9000 + " --></data>")
    (tmp_path / "d.xml").write_bytes(document(entry(staff="wide"), encoding="UTF-16").encode("utf-16"))
    (tmp_path / "e.xml").write_text(document(*[entry(staff=f"E{i}") for i in range(40)]).replace("</row>", "</row >"))
    paths = [str(tmp_path / f"{f}.xml") for f in "abcde"]
    names = spark.read.text(paths).inputFiles()
    assert dict(zip((n[-5] for n in names), xml_scan._of_rows(spark, names), strict=True)) == {
        "a": True, "b": False, "c": False, "d": False, "e": False}
    want = sorted([f"S{i}" for i in range(150)] + [f"I{i}" for i in range(5)] + ["wide"] + [f"E{i}" for i in range(40)])
    for block in (300, 1 << 20):
        got = files.read_time_xml(spark, paths, block=block).collect()
        assert sorted(g["staff_name"] for g in got) == want
        assert {g["purpose"] for g in got} >= {"</row><row> " + "x" * n for n in range(1, 90)}


def test_no_fragment_of_every_tag_is_read(spark, tmp_path):
    """A document of rows reaches the tasks in records of a row, not of a tag."""
    (tmp_path / "a.xml").write_text(document(*[entry(staff=f"S{i}") for i in range(100)]), encoding="utf-8")
    rows, _ = xml_scan.read_rows(spark, [str(tmp_path / "a.xml")], entities=files.DTD_ENTITIES)
    assert rows.where("cells is not null").count() == 100 and rows.where("body is not null").count() == 0
    assert xml_scan._of_rows(spark, spark.read.text(str(tmp_path / "a.xml")).inputFiles()) == [True]


def test_an_element_is_one_match():
    """Tags within a plain row are gone over at once."""
    row = b"<row a='>'><cell name='a'>x<![CDATA[</row>]]></cell><b/><!-- <c> --><c>y</c ></row>"
    lexer = xml_scan.Lexer(b"<data>" + row * 3, xml_scan.TEXT, xml_scan.ROW)
    assert [(t[0], t[1]) for t in lexer] == [(True, b"data")] + [(True, b"row"), (False, b"row")] * 3
