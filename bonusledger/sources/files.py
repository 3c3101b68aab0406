"""File sources: the budget export (tab-separated CSV, S1/S2/S4) and the time
export (XML rows of named cells, S3/S5).

Both produce the schemas the operators expect:
  budget lines: file_path, row_no, projekte, flag, package, soll_txt, ist_txt,
                budget_txt, sollhonorar_txt, billed_txt, cost_txt (strings)
  time entries: staff_name, project, work_package_name, date_text, number,
                time_from, time_to, purpose, is_client_changed, purpose_internal,
                booked_on, hours, source_file, month, quarter, proj_norm, ms_norm
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import ordered
from ..session import materialize
from . import bridge, xml_scan

# ---------------------------------------------------------------- budget CSV

REQUIRED = [K.PROJECT_COLUMN, K.COL_PACKAGE, K.COL_FLAG, K.COL_TARGET_HOURS, K.COL_ACTUAL_HOURS]
INTERNAL = {
    K.PROJECT_COLUMN: "projekte",
    K.COL_FLAG: "flag",
    K.COL_PACKAGE: "package",
    K.COL_TARGET_HOURS: "soll_txt",
    K.COL_ACTUAL_HOURS: "ist_txt",
    K.COL_BUDGET: "budget_txt",
    K.COL_TARGET_FEE: "sollhonorar_txt",
    K.COL_BILLED_FEE: "billed_txt",
    K.COL_COST: "cost_txt",
}


BLANKS = "\u200b\ufeff"  # zero-width characters that headers may hold


def detect_encodings(fragments: DataFrame) -> DataFrame:
    """(file_path, encoding) per budget file: a UTF-16 byte-order mark wins, then
    a UTF-8 one, then valid UTF-8 in every line, else Windows-1252."""
    mark = F.min_by(F.hex(F.substring("bytes", 1, 2)), F.struct("at", "n"))
    marks = fragments.groupBy("file_path").agg(mark.alias("mark"), F.bool_and(F.is_valid_utf8(F.col("bytes").cast("string"))).alias("utf8"))
    return marks.select("file_path", F.when(F.col("mark") == "FFFE", F.lit("UTF-16LE")).when(F.col("mark") == "FEFF", F.lit("UTF-16BE"))
                        .when(F.col("utf8"), F.lit("UTF-8")).otherwise(F.lit("windows-1252")).alias("encoding"))


def _utf16_lines(fragments: DataFrame) -> DataFrame:
    """Lines of UTF-16 files from fragments that end at a byte 0A.  Such a byte may
    be half of another character: it ends a line if it stands at a code unit's low
    byte and the high byte is zero, which the bytes before the fragment in its file
    tell, a running sum over the file's splits.  Fragments of a line are joined."""
    little = F.col("encoding") == "UTF-16LE"
    d = ordered.block_scan(fragments.withColumn("size", F.octet_length("bytes") + 1), "file_path", "at", "n",
                           {"upto": F.col("size")}, {"before": F.hex(F.expr("right(bytes, 1)"))})
    at = F.col("upto") - F.col("size")  # offset of the fragment; the byte 0A stands before it
    begins = F.when(little, (at % 2 == 1) & (F.hex(F.substring("bytes", 1, 1)) == "00")).otherwise(
        (at % 2 == 0) & (F.col("before") == "00"))
    d = d.withColumn("begins", F.coalesce(begins, F.lit(False)) | (at == 0))
    d = ordered.block_scan(d, "file_path", "at", "n", {"line": F.col("begins").cast("long")}, {})
    parts = F.sort_array(F.collect_list(F.struct("at", "n", "bytes")))
    lines = d.groupBy("file_path", "encoding", "line").agg(F.min("at").alias("at"), F.min("n").alias("n"), parts.alias("parts"))
    whole = F.aggregate("parts", F.lit(None).cast("binary"), lambda got, p: F.when(got.isNull(), p["bytes"]).otherwise(
        F.concat(got, F.lit(b"\n"), p["bytes"])))
    lines = lines.withColumn("bytes", whole)
    # what a line's end leaves of its newline: the high byte before the next line, or at its own end
    bare = F.when(little, F.expr("substring(bytes, if(line = 1, 1, 2))")).otherwise(
        F.expr("substring(bytes, 1, octet_length(bytes) - octet_length(bytes) % 2)"))
    return lines.select("file_path", "encoding", "at", "n", bare.alias("bytes"))


def _budget_text(spark: SparkSession, paths: list[str], encoding: str | None) -> DataFrame:
    """Lines of budget files: file_path, row_no (from 1, without gaps), line."""
    raw = spark.read.option("lineSep", "\n").text(paths).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("at"),
        F.monotonically_increasing_id().alias("n"), F.col("value").cast("binary").alias("bytes"))
    raw = materialize(raw, "budget-bytes")
    if encoding and encoding.upper() not in ("UTF-16", "UTF16"):
        raw = raw.withColumn("encoding", F.lit(encoding))
    else:
        raw = raw.join(materialize(detect_encodings(raw), "encodings"), "file_path")
    wide = F.col("encoding").isin("UTF-16LE", "UTF-16BE")
    columns = ["file_path", "encoding", "at", "n", "bytes"]
    lines = raw.where(~wide).select(columns).unionByName(_utf16_lines(raw.where(wide)).select(columns))
    enc = F.col("encoding")
    text = (F.when(F.upper(enc) == "UTF-8", F.col("bytes").cast("string")).when(enc == "UTF-16LE", F.decode("bytes", "UTF-16LE"))
            .when(enc == "UTF-16BE", F.decode("bytes", "UTF-16BE")).otherwise(F.decode("bytes", encoding or "windows-1252")))
    # a carriage return ends a line too; one before the newline belongs to it
    lines = lines.select("file_path", "at", "n", F.split(F.regexp_replace(text, "\r$", ""), "\r").alias("lines"))
    lines = ordered.block_scan(lines, "file_path", "at", "n", {"upto": F.size("lines").cast("long")}, {})
    return lines.select("file_path", F.posexplode("lines").alias("pos", "line"), "upto", F.size("lines").alias("k")).select(
        "file_path", (F.col("upto") - F.col("k") + F.col("pos") + 1).alias("row_no"), "line")


# a field in quotes, and a field as such, each up to its tab
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+"[^\t]*+'
_FIELDS = rf'(?:(?:{_QUOTED}|[^"\t][^\t]*+|)\t)*+'
_OPEN = r'"[^"]*+(?:""[^"]*+)*+$'


def _records(lines: DataFrame) -> DataFrame:
    """Lines joined where a quoted field goes over several: file_path, row_no of the
    first line, record.

    Whether a line begins inside quotes depends on all lines before it.  Each line
    says what it makes of either case: it keeps it, turns it round or sets it.  The
    last line that set it and the number of turns since (a fill and a sum over the
    file, both scans of chunks) give the true case of every line."""
    quoted = F.instr("line", '"') > 0
    opens = quoted & F.col("line").rlike(f"(?s)^{_FIELDS}{_OPEN}")  # outside before, inside after it
    stays = ~quoted | F.col("line").rlike('(?s)^[^"]*+(?:""[^"]*+)*+$') | F.col("line").rlike(
        rf'(?s)^[^"]*+(?:""[^"]*+)*+"[^\t]*+\t{_FIELDS}{_OPEN}')  # inside before and after it
    lines = materialize(lines.withColumns({"opens": opens, "stays": stays}), "budget-lines")
    if lines.where("opens").isEmpty():
        return lines.select("file_path", "row_no", F.col("line").alias("record"))
    turns, sets = F.col("opens") & ~F.col("stays"), F.col("opens") == F.col("stays")
    d = ordered.scan(lines, sums={"turned": turns.cast("long")})
    d = ordered.scan(d, prior_fills={"set": F.when(sets, F.col("opens").cast("long") + F.col("turned"))})
    before = F.col("turned") - turns.cast("long")
    inside = (F.coalesce(F.col("set"), F.lit(0)) + before) % 2 == 1
    d = ordered.scan(d.withColumn("inside", inside), fills={"first": F.when(~F.col("inside"), F.col("row_no"))})
    parts = F.sort_array(F.collect_list(F.struct("row_no", "line")))
    return d.groupBy("file_path", F.col("first").alias("row_no")).agg(F.array_join(F.transform(parts, lambda p: p["line"]), "\n").alias("record"))


def _fields(record):
    """The fields of a record, as many as it has; null if empty."""
    of_quotes = F.transform(F.regexp_extract_all(F.concat(F.lit("\t"), record), F.lit(rf"(?s)\t({_QUOTED}|[^\t]*+)"), F.lit(1)),
                            lambda f: F.when(f.startswith('"'), F.replace(F.regexp_replace(
                                f, r'(?s)^"([^"]*+(?:""[^"]*+)*+)"(.*)$', "$1$2"), F.lit('""'), F.lit('"'))).otherwise(f))
    fields = F.when(F.instr(record, '"') > 0, of_quotes).otherwise(F.split(record, "\t"))
    return F.transform(fields, lambda f: F.nullif(f, F.lit("")))


def clean_name(c):
    """A header's name, stripped and without zero-width characters."""
    return S.strip_unicode(F.translate(c, BLANKS, ""))


def _place(header, name: str):
    """1-based place of a column in a file's header, null if it has none; the
    project column may go by an alias, the first that is there."""
    names = [name, *(K.PROJECT_COLUMN_ALIASES if name == K.PROJECT_COLUMN else [])]
    return F.coalesce(*[F.nullif(F.array_position(header, n), F.lit(0)) for n in names])


def check_headers(headers: DataFrame) -> DataFrame:
    """Raises if a file lacks a required column, naming file and columns."""
    missing = F.filter(F.array(*[F.when(_place(F.col("header"), c).isNull(), F.lit(c)) for c in REQUIRED]), lambda c: c.isNotNull())
    bad = headers.select("file_path", "header", missing.alias("missing")).where(F.size("missing") > 0).take(1)
    if bad:
        raise ValueError(f"{bad[0]['file_path']}: no column {', '.join(bad[0]['missing'])} among {bad[0]['header']}")
    return headers


def read_budget_csv(spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None,
                    multiline: bool = True) -> DataFrame:
    """S1 + S2: budget lines of one or more exports, all columns as strings.

    Every file's own header names its columns, of any number.  Files in all
    encodings are split among tasks, quoted fields over several lines included
    (``multiline=False`` ends a record with its line).  ``row_no`` is the line of a
    record's begin.  Only empty fields are null (D22).
    """
    lines = _budget_text(spark, [paths] if isinstance(paths, str) else list(paths), encoding)
    records = _records(lines) if multiline else lines.withColumnRenamed("line", "record")
    records = records.where(F.translate("record", BLANKS, "") != "")
    out = materialize(records.select("file_path", "row_no", _fields(F.col("record")).alias("v")), "budget-csv")
    headers = out.groupBy("file_path").agg(F.min_by("v", "row_no").alias("header"), F.min("row_no").alias("head_no"))
    headers = check_headers(headers.withColumn("header", F.transform("header", clean_name)))
    out = out.join(headers, "file_path").where("row_no > head_no")
    return out.select("file_path", "row_no", *[
        F.get("v", (_place(F.col("header"), name) - 1).cast("int")).alias(c) for name, c in INTERNAL.items()])


def budget_source(spark: SparkSession, uploaded: str | None, default_path: str) -> DataFrame:
    """An uploaded export overrides the central one."""
    return read_budget_csv(spark, uploaded or default_path)


# ---------------------------------------------------------------- time XML

# Entities the export may use without declaring them; those that a
# document declares come from its prolog, the five predefined ones from the parser.
DTD_ENTITIES = {"shy": "&#173;", "nbsp": "&#160;"}
CELLS = ["staff_name", "project", "work_package_name", "date", "number", "time_from", "time_to",
         "purpose", "is_client_changed", "purpose_internal"]
ROW_SCHEMA = "cell ARRAY<STRUCT<_VALUE: STRING, _name: STRING>>, _corrupt_record STRING"


def _plain_cdata(text):
    """CDATA sections as escaped characters, comments left out."""
    esc = lambda t: F.replace(F.replace(F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    end = lambda p: F.instr(p, "]]>")
    parts = F.transform(F.split(text, r"<!\[CDATA\[", -1), lambda p, i: F.when((i == 0) | (end(p) == 0), p).otherwise(
        F.concat(esc(F.substr(p, F.lit(1), end(p) - 1)), F.substr(p, end(p) + 3))))
    plain = ~F.contains(text, F.lit("<![CDATA[")) & ~F.contains(text, F.lit("<!--"))  # most rows
    return F.when(plain, text).otherwise(F.regexp_replace(F.array_join(parts, ""), "(?s)<!--.*?-->", ""))


def declared_entities(text):
    """[(name, replacement)] of a document's prolog, as an array of structs."""
    prolog = F.regexp_extract(text, r"(?s)<!DOCTYPE[^\[>]*\[(.*?)\]\s*>", 1)
    pattern = r"""<!ENTITY\s+([^\s%"']+)\s+["']([^"']*)["']\s*>"""
    return F.transform(F.regexp_extract_all(prolog, F.lit(pattern), F.lit(0)), lambda e: F.struct(
        F.regexp_extract(e, pattern, 1).alias("name"), F.regexp_extract(e, pattern, 2).alias("value")))


def _row_cells(spark: SparkSession, paths: str | Sequence[str], entities: dict[str, str] | None, block: int) -> DataFrame:
    entities = entities or DTD_ENTITIES
    rows, prologs = xml_scan.read_rows(spark, [paths] if isinstance(paths, str) else list(paths), block, entities)
    plain, rows = rows.where("body is null").select("source_file", "cells"), rows.where("body is not null")
    declared = prologs.select("source_file", declared_entities(F.col("prolog")).alias("declared")).where("size(declared) > 0")
    rows = rows.withColumn("body", _plain_cdata(F.col("body"))).join(declared, "source_file", "left")
    none = F.array().cast("array<struct<name:string,value:string>>")
    return plain.union(row_cells(rows.withColumn("declared", F.coalesce("declared", none)), entities))


def read_time_xml(spark: SparkSession, paths: str | Sequence[str], entities: dict[str, str] | None = None,
                  block: int = xml_scan.BLOCK) -> DataFrame:
    """S3 + S5: every <row> of every file, its <cell name=..> texts by name (the
    last of a repeated name wins), valid rows only (P1), normalised (F9, F11, F16).

    A document of any size is lexed by many tasks (``xml_scan``); rows may be nested,
    a row's cells are its own.  Documents that are truncated or unbalanced are an
    error when this is called, a row that can't be parsed is one when it is read.
    """
    return valid_entries(_row_cells(spark, paths, entities, block))


def scan_time_xml(spark: SparkSession, paths: str | Sequence[str], entities: dict[str, str] | None = None,
                  block: int = xml_scan.BLOCK) -> tuple[DataFrame, DataFrame]:
    """``read_time_xml`` and the account of what could not be read (``entry_account``),
    both over rows that are parsed and landed once."""
    cells = materialize(_row_cells(spark, paths, entities, block), "time-rows")
    return valid_entries(cells), entry_account(cells)


def parse_row_fragments(frag: DataFrame, entities: dict[str, str] | None = None) -> DataFrame:
    """Text fragments ending before '</row>' (columns value, source_file) ->
    normalised time entries, for streams of UTF-8 documents without CDATA."""
    begin = r"<row(?:\s[^>]*)?(?<!/)>"
    frag = frag.where(F.col("value").rlike(begin))
    body = F.regexp_extract("value", f"(?s)^.*{begin}(.*)$", 1)
    none = F.array().cast("array<struct<name:string,value:string>>")
    return parse_rows(frag.select("source_file", none.alias("declared"), body.alias("body")), entities)


def parse_rows(rows: DataFrame, entities: dict[str, str] | None = None) -> DataFrame:
    """Inner XML of rows (source_file, declared, body) -> normalised time entries."""
    return valid_entries(row_cells(rows, entities))


def row_cells(rows: DataFrame, entities: dict[str, str] | None = None) -> DataFrame:
    """Inner XML of rows -> source_file, cells (map from name to text)."""
    body = F.aggregate("declared", F.col("body"), lambda b, e: F.replace(b, F.concat(F.lit("&"), e["name"], F.lit(";")), e["value"]))
    for name, repl in (entities or DTD_ENTITIES).items():
        body = F.replace(body, F.lit(f"&{name};"), F.lit(repl))
    row_xml = F.concat(F.lit("<row>"), body, F.lit("</row>"))
    parsed = rows.select("source_file", row_xml.alias("xml")).withColumn("r", F.from_xml("xml", ROW_SCHEMA))
    bad = F.col("r").isNull() | F.col("r._corrupt_record").isNotNull()
    message = F.concat(F.lit("row that is not XML in "), F.col("source_file"), F.lit(": "), F.substring("xml", 1, 200))
    parsed = parsed.withColumn("r", F.when(bad, F.raise_error(message)).otherwise(F.col("r")))
    # the pattern spares texts that have nothing to strip the search for white space
    strip = lambda v: F.when(v.rlike(r"(?s)^[!-~](?:.*[!-~])?\z"), v).otherwise(S.strip_unicode(v))
    cells = F.map_from_entries(F.transform(
        F.coalesce(F.col("r.cell"), F.array().cast("array<struct<_VALUE:string,_name:string>>")),
        lambda c: F.struct(c["_name"].alias("k"), F.coalesce(strip(c["_VALUE"]), F.lit("")).alias("v")),
    ))
    # given out by a generator, so that no filter on the cells is moved below it and parses every row again
    return parsed.select("source_file", F.explode(F.array(cells)).alias("cells"))


def _lacks() -> dict:
    """What makes a row no booking."""
    return {
        "no_staff": F.coalesce(F.element_at("cells", F.lit("staff_name")), F.lit("")) == "",
        "no_package": ~F.map_contains_key("cells", F.lit("work_package_name")),
        "no_date": ~F.map_contains_key("cells", F.lit("date")),
    }


def entry_account(cells: DataFrame) -> DataFrame:
    """Per file what a report can't show: rows without cells, rows that P1 drops by
    reason (the first that holds), and of the bookings those whose date is no date,
    whose month token is unknown (read as January, D18), and whose hours are no number
    (read as 0, F11)."""
    empty = F.size("cells") == 0
    lacks = _lacks()
    valid = ~empty & ~lacks["no_staff"] & ~lacks["no_package"] & ~lacks["no_date"]
    cell = lambda name: F.element_at("cells", F.lit(name))
    count = lambda c: F.count(F.when(c, 1))
    return cells.groupBy("source_file").agg(
        F.count("*").alias("n_rows"), count(valid).alias("n_bookings"), count(empty).alias("no_cells"),
        count(~empty & lacks["no_staff"]).alias("no_staff"),
        count(~empty & ~lacks["no_staff"] & lacks["no_package"]).alias("no_package"),
        count(~empty & ~lacks["no_staff"] & ~lacks["no_package"] & lacks["no_date"]).alias("no_date"),
        count(valid & S.booking_date(cell("date")).isNull()).alias("date_unread"),
        count(valid & S.month_token_unknown(cell("date"))).alias("month_unknown"),
        count(valid & S.hours_unread(cell("number"))).alias("hours_unread"))


def budget_account(lines: DataFrame) -> DataFrame:
    """Per budget file and number column the texts that are no number, hence null."""
    unread = [F.struct(F.lit(c).alias("column"), (S.strip_unicode(F.col(c)).isNotNull() & (S.strip_unicode(F.col(c)) != "")
                                                  & S.de_number(c).isNull()).alias("unread"))
              for c in ("soll_txt", "ist_txt", "budget_txt", "sollhonorar_txt", "billed_txt", "cost_txt")]
    d = lines.select("file_path", F.inline(F.array(*unread)))
    return d.groupBy("file_path", "column").agg(F.count(F.when(F.col("unread"), 1)).alias("n_unread"))


def valid_entries(cells: DataFrame) -> DataFrame:
    """The bookings among parsed rows (P1), normalised."""
    lacks = _lacks()
    d = cells.where(~(lacks["no_staff"] | lacks["no_package"] | lacks["no_date"]))
    d = d.select("source_file", *[F.element_at("cells", F.lit(c)).alias(c) for c in CELLS])
    d = d.withColumnRenamed("date", "date_text").withColumns({
        "booked_on": S.booking_date("date_text"),
        "hours": S.booking_hours("number"),
        "month_unknown": S.month_token_unknown("date_text"),  # D18: counted, still read as January
    })
    return bridge.with_entry_keys(d)


def require_rows(df: DataFrame) -> DataFrame:
    """The reference's empty-input error, as an explicit (one-row) action."""
    if df.isEmpty():
        raise ValueError("the time export holds no booking")
    return df
