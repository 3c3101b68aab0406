"""The split scan of XML documents against a parser of whole documents: any block
size, encodings, nested rows, markup that holds tags, and documents that are cut."""

import json
import random
import xml.etree.ElementTree as ET

import pytest
from test_sources import document, entry

from bonusledger.sources import files, xml_scan

CODECS = [("UTF-8", "utf-8"), ("UTF-16", "utf-16"), ("ISO-8859-1", "latin-1"), ("UTF-16", "utf-16-le"), ("UTF-16", "utf-16-be")]


def random_document(r, encoding="UTF-8", codec="utf-8"):
    odd = "ö" if codec == "latin-1" else r.choice(["ö", "日本", "㰀㰼", "😀", "ā㰊"])

    def text():
        return r.choice(["", "x", odd, " 5 > 3 ", "&amp;", "<![CDATA[<row> ]] > </row>]]>", "<!-- <row> > -->", "<?p <row> ?>", "\n"])

    def element(depth):
        name = r.choice(["row", "row", "cell", "g", "rowcount"])
        attributes = "".join(f" {a}={q}{r.choice(['v', 'a>b', odd, '/', '>/'])}{q}" for a, q in (("a", '"'), ("b", "'")) if r.random() < 0.4)
        if r.random() < 0.2:
            return f"<{name}{attributes}{r.choice(['', ' '])}/>"
        inner = text() + "".join(element(depth + 1) + text() for _ in range(r.randint(0, 4 if depth < 4 else 0)))
        return f"<{name}{attributes}>{inner}</{name}{r.choice(['', ' '])}>"

    prolog = r.choice(["", "<!DOCTYPE data>", "<!DOCTYPE data [<!ENTITY e 'a>b'><!ELEMENT row ANY> ] >", "<!-- <row> -->"])
    return f'<?xml version="1.0" encoding="{encoding}"?>{prolog}<data>{text()}{element(0)}{element(0)}{text()}</data>\n'


def blocks_of(raw, cuts):
    """What the reader makes of a file: blocks that, but for the first, begin at a '<'."""
    parts = raw.split(b"<")
    out, at, now = [], 0, [parts[0]]
    for p in parts[1:]:
        if at in cuts:
            out.append(b"<".join(now))
            now = [b""]
        now.append(p)
        at += 1
    out.append(b"<".join(now))
    rows = []
    for i, block in enumerate(out):
        states = (0,) if i == 0 else range(8)
        found = {f: xml_scan.effects_of(xml_scan.units(block, f), states) for f in xml_scan.forms(block)}
        for f, effects in found.items():  # shared tags change nothing
            for s, effect in effects.items():
                lexer = xml_scan.Lexer(xml_scan.units(block, f), s)
                assert xml_scan._reduced(list(lexer), lexer.state) == effect
        rows.append({"source_file": "f", "at": 0, "seq": i, "size": len(block), "last": block[-1:].hex(), "effects": json.dumps(found),
                     "head": block[:xml_scan.HEAD], "block": block})
    return rows


def scanned(raw, cuts):
    blocks = blocks_of(raw, cuts)
    rows = {}
    for b, start in zip(blocks, xml_scan.compose(blocks), strict=True):
        for key, _, body in xml_scan.pieces(b | start):
            rows[key] = rows.get(key, b"") + body
    codec = {"UTF-8": "utf-8", "ISO-8859-1": "latin-1", "UTF-16LE": "utf-16-le", "UTF-16BE": "utf-16-be"}[start["encoding"]]
    return [body.decode(codec) for _, body in sorted(rows.items())]


def own_text(row):
    """What a row holds without the rows in it."""
    def strip(e):
        for child in list(e):
            if child.tag == "row":
                prior = list(e)[list(e).index(child) - 1] if list(e).index(child) else None
                if prior is None:
                    e.text = (e.text or "") + (child.tail or "")
                else:
                    prior.tail = (prior.tail or "") + (child.tail or "")
                e.remove(child)
            else:
                strip(child)
        return e

    return ET.canonicalize(ET.tostring(strip(ET.fromstring(ET.tostring(row)))))


@pytest.mark.parametrize(("encoding", "codec"), CODECS)
def test_rows_are_those_of_a_parser(encoding, codec):
    r = random.Random(7)
    for n in range(60):
        text = random_document(r, encoding, codec)
        raw = text.encode(codec)
        want = []
        for row in ET.fromstring(raw.decode(codec).replace(f'encoding="{encoding}"', "")).iter("row"):
            row.tail, row.attrib = None, {}
            want.append(own_text(row))
        n_cuts = raw.count(b"<")
        for cuts in (set(), set(range(1, n_cuts)), set(r.sample(range(1, n_cuts), min(3, n_cuts - 1)))):
            got = [own_text(ET.fromstring(f"<row>{body}</row>")) for body in scanned(raw, cuts)]
            assert got == want, (text, cuts)


def test_documents_that_are_not_whole():
    r = random.Random(3)
    for _ in range(25):
        raw = random_document(r).encode()
        end = raw.rindex(b">")
        for at in [*r.sample(range(40, end), 8), end]:
            with pytest.raises(ValueError, match="not a whole XML document: f"):
                scanned(raw[:at], set(range(1, raw[:at].count(b"<"))))
    for bad in ["<a><row></a></row>", "<a></a><b></b>", "<a></a></a>", "<a>< b></a>", "no document", "<a><b></a>", "<a",
                "<a><!-- </a>", "<a><![CDATA[</a>", "<a b='></a>", "<!DOCTYPE a [<!ENTITY e 'f'> <a></a>"]:
        for cuts in (set(), set(range(1, 9))):
            with pytest.raises(ValueError, match="not a whole XML document"):
                scanned(bad.encode(), cuts)
    assert scanned(b"<a><row/><row>x</row></a><!-- > --> <?p?>", {1, 2, 3, 4}) == ["", "x"]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.mark.parametrize(("name", "codec"), [("UTF-8", "utf-8"), ("UTF-16", "utf-16")])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, small_splits, name, codec):
    rows = [entry(staff=f"S{i}㰼" if codec == "utf-16" else f"Sö{i}", purpose="<![CDATA[<row> " + "x" * (i % 700) + "]]>") for i in range(120)]
    (tmp_path / "a.xml").write_bytes(document(*rows, encoding=name).encode(codec))
    (tmp_path / "b.xml").write_bytes(document(entry(staff="other")).encode())
    raw = spark.read.option("lineSep", "<").text(str(tmp_path / "a.xml"))
    assert raw.rdd.getNumPartitions() > 5
    got = files.read_time_xml(spark, [str(tmp_path / f) for f in ("a.xml", "b.xml")], block=500).collect()
    want = sorted([f"S{i}㰼" if codec == "utf-16" else f"Sö{i}" for i in range(120)] + ["other"])
    assert sorted(r["staff_name"] for r in got) == want
    assert {r["purpose"] for r in got} >= {"<row> " + "x" * 5, "<row> " + "x" * 119}


def test_nested_rows_are_bookings_of_their_own(spark, tmp_path):
    inner = entry(staff="inner")
    outer = entry(staff="outer").replace("</row>", f"<group>{inner}</group>{entry(staff='second')}</row>")
    (tmp_path / "n.xml").write_text(document(outer, entry(staff="last")), encoding="utf-8")
    got = files.read_time_xml(spark, str(tmp_path / "n.xml"), block=50).collect()
    assert sorted(r["staff_name"] for r in got) == ["inner", "last", "outer", "second"]


def test_truncated_and_empty_files_are_errors(spark, tmp_path):
    text = document(entry(), entry(staff="lost"))
    (tmp_path / "cut.xml").write_text(text[:text.rindex("</row>")], encoding="utf-8")
    (tmp_path / "empty.xml").write_text("")
    (tmp_path / "good.xml").write_text(text, encoding="utf-8")
    with pytest.raises(Exception, match="not a whole XML document.*cut.xml"):
        files.read_time_xml(spark, [str(tmp_path / "good.xml"), str(tmp_path / "cut.xml")]).collect()
    with pytest.raises(ValueError, match="empty.xml: it is empty"):
        files.read_time_xml(spark, [str(tmp_path / "good.xml"), str(tmp_path / "empty.xml")])
