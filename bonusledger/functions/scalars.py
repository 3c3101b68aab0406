"""Scalar functions of the budget/bookings model as Spark Column expressions.

All are built-in expressions (JVM side, whole-stage codegen); none is a UDF.
Each takes and returns ``Column``; names follow the model, not the workbook.
"""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

HOURS = "decimal(18,2)"
# Hours and money inside: nothing is rounded before it is added up.
EXACT = "decimal(30,8)"

# Numbers after German normalisation: optional sign, digits with one optional
# dot, or a leading-dot fraction.  Anything else is "not a number" (null).
_NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)$"
# Dot-decimal numbers of the time export (exponent allowed, as Python float does).
_NUMERIC_EXP = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def de_number(x) -> Column:
    """German number text -> exact decimal; null, not a number or over 22
    digits before the comma -> null.

    Strip, delete every '.', turn ',' into '.', parse.  "1.234,56" -> 1234.56.
    """
    s = F.replace(F.replace(strip_unicode(x), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return F.when(s.rlike(_NUMERIC), s.try_cast(EXACT))


def strip_unicode(x) -> Column:
    """Python ``str.strip()``: removes Unicode white space at both ends."""
    return F.regexp_replace(_c(x), r"(?U)^\s+|\s+$", "")


def norm_milestone(x) -> Column:
    """F2 / F16: milestone key.  Null -> ''; bullets removed anywhere; leading
    dashes and spaces dropped; stripped."""
    s = F.translate(F.coalesce(_c(x), F.lit("")), "•●", "")
    return F.regexp_replace(s, r"(?U)^[\-\s]+|\s+$", "")


def norm_project(x) -> Column:
    """F16: project key = stripped name ('' for null)."""
    return strip_unicode(F.coalesce(_c(x), F.lit("")))


def milestone_type(x) -> Column:
    """'quarterly' if the name contains 'quartal' (any case), else 'monthly'."""
    return F.when(F.lower(_c(x)).contains("quartal"), F.lit("quarterly")).otherwise(F.lit("monthly"))


_BUDGET_IN_NAME = K.BUDGET_IN_NAME


def name_budget_hours(x) -> Column:
    """F4 hours part: '(max. 8h/Monat pro MA)' -> 8.00; no match -> null."""
    unit = F.regexp_extract(_c(x), _BUDGET_IN_NAME, 2)
    num = F.replace(F.regexp_extract(_c(x), _BUDGET_IN_NAME, 1), F.lit(","), F.lit("."))
    return F.when(unit != "", num.try_cast(EXACT))


def name_budget_unit(x) -> Column:
    """F4 unit part: 'monat' / 'quartal' (lower case) or null."""
    unit = F.lower(F.regexp_extract(_c(x), _BUDGET_IN_NAME, 2))
    return F.when(unit != "", unit)


def is_special_project(x) -> Column:
    """stripped name starts with '0000'; null -> false."""
    return F.coalesce(F.lower(strip_unicode(_c(x))).startswith("0000"), F.lit(False))


def is_supplement_package(x) -> Column:
    """package text contains 'nat' or 'nachtrag' (case-insensitive)."""
    return F.coalesce(F.lower(_c(x)).rlike("nat|nachtrag"), F.lit(False))


def status_band(pct) -> Column:
    """utilisation band: < 90 green, <= 100 yellow, else red."""
    p = _c(pct)
    return (
        F.when(p < K.STATUS_GREEN_BELOW, F.lit("green"))
        .when(p <= K.STATUS_YELLOW_UPTO, F.lit("yellow"))
        .otherwise(F.lit("red"))
    )


def billing_type(package, flag, force: bool | Column = False) -> Column:
    """F8: 'Pauschale' for '(p)', 'Nachweis' for '(an)'/'(a.n.)'/'(a n)', else
    'Unbekannt'.  Without ``force`` only top-level rows (flag X) are classified."""
    low = F.lower(_c(package))
    flag_x = F.upper(strip_unicode(F.coalesce(_c(flag), F.lit("")))) == "X"
    forced = force if isinstance(force, Column) else F.lit(bool(force))
    proof = None
    for marker in K.BILLING_PROOF_MARKERS:
        cond = low.contains(marker)
        proof = cond if proof is None else (proof | cond)
    kind = (
        F.when(_c(package).isNull(), F.lit(K.BILLING_UNKNOWN))
        .when(low.contains(K.BILLING_FLAT_MARKER), F.lit(K.BILLING_FLAT))
        .when(proof, F.lit(K.BILLING_PROOF))
        .otherwise(F.lit(K.BILLING_UNKNOWN))
    )
    return F.when(forced | flag_x, kind).otherwise(F.lit(K.BILLING_UNKNOWN))


_DATE_TEXT = r"(?U)(\d{1,2})\s+(\w{3})\s+(\d{4})"


def _month_number_map() -> Column:
    pairs = []
    for i, token in enumerate(K.ENGLISH_MONTH_TOKENS, start=1):
        pairs += [F.lit(token), F.lit(f"{i:02d}")]
    return F.create_map(*pairs)


def booking_date(x) -> Column:
    """first 'd Mon yyyy' in the text -> DATE.  Unknown month token -> January;
    impossible dates (31 Feb) -> null; weekday and zone are ignored."""
    found = F.split(F.regexp_extract(F.coalesce(_c(x), F.lit("")), _DATE_TEXT, 0), r"(?U)\s+")
    day, mon, year = (F.get(found, F.lit(i)) for i in range(3))
    mm = F.coalesce(F.element_at(_month_number_map(), mon), F.lit("01"))
    # of no date, year and text are null
    return F.concat(year, F.lit("-"), mm, F.lit("-"), F.lpad(day, 2, "0")).try_cast("date")


def month_token_unknown(x) -> Column:
    """D18 helper: the date text matched but its month token is not English."""
    s = F.coalesce(_c(x), F.lit(""))
    mon = F.regexp_extract(s, _DATE_TEXT, 2)
    return (mon != "") & F.element_at(_month_number_map(), mon).isNull()


def month_start(d) -> Column:
    """first day of the month as DATE."""
    return F.trunc(_c(d), "month")


def quarter_start(d) -> Column:
    """first day of the quarter as DATE."""
    return F.trunc(_c(d), "quarter")


def booking_hours(x) -> Column:
    """dot-decimal hours; null, empty or not a number -> 0 ('8,00' -> 0), as
    is what has over 22 digits before the point: a bad value never ends a job."""
    s = strip_unicode(x)
    exact = F.coalesce(s.try_cast(EXACT), s.try_cast("double").try_cast(EXACT))
    return F.coalesce(F.when(s.rlike(_NUMERIC_EXP), exact), F.lit(0).cast(EXACT))


def hours_unread(x) -> Column:
    """Whether F11 reads a text as 0 because it is no number (or too long a one)."""
    s = strip_unicode(x)
    exact = F.coalesce(s.try_cast(EXACT), s.try_cast("double").try_cast(EXACT))
    return F.coalesce((s != "") & ~(s.rlike(_NUMERIC_EXP) & exact.isNotNull()), F.lit(False))


def rounded(df):
    """The exact columns of an output rounded to two decimals (null where even
    that is too long)."""
    wide = [f.name for f in df.schema.fields if f.dataType.simpleString() == EXACT]
    return df.withColumns({c: F.col(c).try_cast(HOURS) for c in wide}) if wide else df


_Q_FIRST = re.compile(K.QUARTER_FIRST)
_Q_LAST = re.compile(K.QUARTER_LAST)


def parse_quarter(text: str) -> date:
    """F12 (driver side, for a job parameter): 'Q3-2025', '2025Q3', ... -> first
    day of the quarter."""
    s = text.strip().upper()
    m = _Q_FIRST.match(s)
    if m:
        q, y = int(m.group(1)), int(m.group(2))
    else:
        m = _Q_LAST.match(s)
        if not m:
            raise ValueError(f"{text!r} names no quarter")
        y, q = int(m.group(1)), int(m.group(2))
    if not 1 <= q <= 4:
        raise ValueError(f"{text!r} names no quarter")
    return date(y, 3 * (q - 1) + 1, 1)


def quarter_of_text(x) -> Column:
    """F12 as a column: the same two patterns; no match or quarter digit outside
    1..4 -> null."""
    s = F.upper(F.trim(_c(x)))
    q1 = F.regexp_extract(s, K.QUARTER_FIRST, 1)
    y1 = F.regexp_extract(s, K.QUARTER_FIRST, 2)
    y2 = F.regexp_extract(s, K.QUARTER_LAST, 1)
    q2 = F.regexp_extract(s, K.QUARTER_LAST, 2)
    q = F.when(q1 != "", q1).otherwise(q2).try_cast("int")
    y = F.when(q1 != "", y1).otherwise(y2).try_cast("int")
    return F.when(q.between(1, 4), F.make_date(y, q * 3 - 2, F.lit(1)))


def project_code(x) -> Column:
    """First white-space token of the stripped project name."""
    return F.regexp_extract(norm_project(x), r"(?U)^(\S+)", 1)


def project_keys(x) -> Column:
    """[stripped name, first token] without duplicates or empties."""
    full = norm_project(x)
    keys = F.array_distinct(F.array(full, project_code(x)))
    return F.filter(keys, lambda k: k != "")


def month_label(d) -> Column:
    """'Oktober 2025'."""
    names = F.array(*[F.lit(m) for m in K.GERMAN_MONTHS])
    return F.concat_ws(" ", F.element_at(names, F.month(_c(d))), F.year(_c(d)).cast("string"))


def range_label(start, end) -> Column:
    """'dd.mm.yyyy - dd.mm.yyyy'."""
    return F.concat_ws(" - ", F.date_format(_c(start), "dd.MM.yyyy"), F.date_format(_c(end), "dd.MM.yyyy"))


def week_label(week, start, end) -> Column:
    """'KW n (dd.mm - dd.mm.yyyy)'."""
    return F.concat(
        F.lit("KW "), _c(week).cast("string"), F.lit(" ("),
        F.date_format(_c(start), "dd.MM"), F.lit(" - "), F.date_format(_c(end), "dd.MM.yyyy"), F.lit(")"),
    )


def block_days(start, end) -> Column:
    """inclusive number of days."""
    return F.datediff(_c(end), _c(start)) + 1


def days_in_month(d) -> Column:
    """days of the month containing d."""
    return F.dayofmonth(F.last_day(_c(d)))


def pct(ist, soll) -> Column:
    """ist / soll * 100 as double when soll > 0, else 0."""
    s = _c(soll)
    return F.when(s > 0, _c(ist).cast("double") / s.cast("double") * 100.0).otherwise(F.lit(0.0))


def plan_pct(ist, soll) -> Column:
    """F21, plan variant: 999 when there is no target but actual hours."""
    s, i = _c(soll), _c(ist)
    return (
        F.when(s > 0, i.cast("double") / s.cast("double") * 100.0)
        .when(i > 0, F.lit(999.0))
        .otherwise(F.lit(0.0))
    )


def list_items(text) -> Column:
    """F17 on a column: comma list -> stripped non-empty items, none for null."""
    items = F.transform(F.split(F.coalesce(_c(text), F.lit("")), ","), strip_unicode)
    return F.filter(items, lambda x: x != "")


def range_problem(start, end, quarterly) -> Column:
    """P10 on columns: 'order' if a range begins after its end, 'span' if a quarter's
    report does not cover a quarter's days, null if it is well."""
    low, high = K.QUARTER_DAYS
    return F.when(_c(start) > _c(end), "order").when(_c(quarterly) & ~F.datediff(_c(end), _c(start)).between(low, high), "span")


def report_label(start, end, quarterly) -> Column:
    """K5 on columns: 'Q3-2025' for a report of one quarter, else 'Report_<start>-<end>'."""
    one = _c(quarterly) & (F.date_trunc("quarter", _c(start)) == F.date_trunc("quarter", _c(end)))
    return F.when(one, F.concat(F.lit("Q"), F.quarter(_c(start)), F.lit("-"), F.year(_c(start)))).otherwise(
        F.concat(F.lit("Report_"), F.date_format(_c(start), "yyyyMMdd"), F.lit("-"), F.date_format(_c(end), "yyyyMMdd")))


def split_list(text: str | None) -> list[str]:
    """F17 (driver side): comma list -> stripped non-empty items."""
    if not text:
        return []
    return [p.strip() for p in text.split(",") if p.strip()]
