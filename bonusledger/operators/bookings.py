"""Operators over time entries: filters, quarter selection, time blocks, hour
aggregates and the running / future sums.

Input is the normalised entry schema (staff_name, booked_on, hours, month,
quarter, proj_norm, ms_norm, ...).  Everything is a lazy DataFrame transform;
group-level results are aggregated before any window so hot keys (the shared
special project is booked by every employee) reach windows as a few rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S

ROW_KEY = ["proj_norm", "ms_norm"]
# Entries may carry this column: each of its values is a report of its own (S5, one per
# time file), and every aggregate, window and join of bookings goes by it too.
REPORT = "report"


def report_of(*tables: DataFrame) -> list[str]:
    """The report column, if all the tables carry it."""
    return [REPORT] if all(REPORT in t.columns for t in tables) else []


# ---------------------------------------------------------------- filters (P*)

def in_quarter(df: DataFrame, quarter: date | Column) -> DataFrame:
    """Entries of one quarter (rows without a date drop out).

    For a fixed quarter this is a date range on ``booked_on`` and ``month``: it
    reaches the parquet scan as a pushed range filter, and prunes the month
    partitions of a landed entries table."""
    if isinstance(quarter, Column):
        return df.where(F.col("quarter") == quarter)
    q_end = date(quarter.year + (quarter.month + 2) // 12, (quarter.month + 2) % 12 + 1, 1)
    last = date.fromordinal(q_end.toordinal() - 1)
    return df.where(
        F.col("booked_on").between(F.lit(quarter), F.lit(last))
        & F.col("month").between(F.lit(quarter), F.lit(date(last.year, last.month, 1)))
    )


def in_range(df: DataFrame, start: date, end: date) -> DataFrame:
    """P5: inclusive date range; pushed to the scan as two range predicates."""
    return df.where(F.col("booked_on").between(F.lit(start), F.lit(end)))


LITERALS = 50  # a list of so many values is a predicate that the scan can take; longer ones are tables


def _as_table(df: DataFrame, values: Sequence[str] | DataFrame, name: str) -> DataFrame:
    if isinstance(values, DataFrame):
        return values.select(F.col(values.columns[0]).cast("string").alias(name)).where(f"{name} is not null").distinct()
    return df.sparkSession.createDataFrame([(v,) for v in sorted(set(values))], f"{name} string")


def _after(prefix: str) -> str | None:
    """The least string above all that begin with ``prefix``, if there is one."""
    while prefix:
        last = ord(prefix[-1]) + 1
        if last <= 0x10FFFF:
            return prefix[:-1] + chr(0xE000 if 0xD800 <= last < 0xE000 else last)
        prefix = prefix[:-1]
    return None


def projects_matching(df: DataFrame, projects: Sequence[str] | DataFrame) -> DataFrame:
    """Project key equal to, or starting with, any listed value (a list, or the
    first column of a table).

    Beyond ``LITERALS`` values the list is an index of prefixes by length: the
    distinct project keys look up their own beginnings of those lengths in it, and
    the rows are kept by a semi-join with the keys that were found.  The range in which all
    matching keys lie is a predicate on the scan either way."""
    if not isinstance(projects, DataFrame):
        if not projects:
            return df
        if len(projects) <= LITERALS:
            cond = F.col("proj_norm").isin(list(projects))
            return df.where(reduce(lambda acc, p: acc | F.col("proj_norm").startswith(p), projects, cond))
        df = df.where(F.col("proj_norm") >= min(projects))
        ends = [_after(p) for p in set(projects)]
        if None not in ends:
            df = df.where(F.col("proj_norm") < max(ends))
    prefixes = _as_table(df, projects, "_prefix").withColumn("_n", F.char_length("_prefix"))
    # distinct lengths of prefixes: as many as a project key has characters at most
    lengths = sorted(r["_n"] for r in prefixes.select("_n").distinct().collect())
    own = F.filter(F.array(*[F.lit(n) for n in lengths]).cast("array<int>"), lambda n: n <= F.char_length("proj_norm"))
    keys = df.select("proj_norm").distinct().select("proj_norm", F.explode(own).alias("_n"))
    found = keys.withColumn("_prefix", F.expr("substring(proj_norm, 1, _n)")).join(prefixes, ["_prefix", "_n"], "left_semi")
    return df.join(found.select("proj_norm").distinct(), "proj_norm", "left_semi")


def employees_matching(df: DataFrame, employees: Sequence[str] | DataFrame) -> DataFrame:
    """Exact, case-sensitive employee names (a list, or the first column of a
    table); a semi-join beyond ``LITERALS`` names."""
    if not isinstance(employees, DataFrame):
        if not employees:
            return df
        if len(employees) <= LITERALS:
            return df.where(F.col("staff_name").isin(list(employees)))
        df = df.where(F.col("staff_name").between(min(employees), max(employees)))
    return df.join(_as_table(df, employees, "staff_name"), "staff_name", "left_semi")


def exclude_special(df: DataFrame) -> DataFrame:
    """P8 (and P9, a subset of it): drop projects matching ^0.?0+ ."""
    return df.where(~F.col("proj_norm").rlike(r"^0\.?0+"))


def check_range(start: date, end: date, quarterly: bool = False) -> None:
    """P10: driver-side parameter checks."""
    if start > end:
        raise ValueError(f"the range begins ({start}) after its end ({end})")
    low, high = K.QUARTER_DAYS
    if quarterly and not low <= (end - start).days <= high:
        raise ValueError(f"a quarter's report covers {low} to {high} days, not {(end - start).days}")


# --------------------------------------------------- quarters

def quarters_available(df: DataFrame) -> DataFrame:
    """Each quarter with its sorted months present in the data."""
    by = report_of(df)
    months = df.where(F.col("month").isNotNull()).select(*by, "quarter", "month").distinct()
    return months.groupBy(*by, "quarter").agg(
        F.sort_array(F.collect_list("month")).alias("months"),
        F.count("*").alias("n_months"),
    )


def latest_quarter(df: DataFrame) -> DataFrame:
    """The latest quarter with data and its months (one row), from one
    pass: the distinct months, at most twelve a year, then their last quarter."""
    months = df.where(F.col("month").isNotNull()).select("quarter", "month").distinct()
    return (months.groupBy("quarter").agg(F.sort_array(F.collect_list("month")).alias("months"), F.count("*").alias("n_months"))
            .orderBy(F.col("quarter").desc()).limit(1))


def quarter_months(quarter: date | Column) -> Column:
    """T5, flexible variant: all three months of a quarter."""
    q = quarter if isinstance(quarter, Column) else F.lit(quarter)
    return F.sequence(q, F.add_months(q, 2), F.expr("interval 1 month"))


# --------------------------------------------------------- aggregates (A*)

def month_hours(df: DataFrame) -> DataFrame:
    """A2: hours per (employee, month, project, milestone)."""
    return df.groupBy(*report_of(df), "staff_name", "quarter", "month", *ROW_KEY).agg(
        F.sum("hours").cast(S.EXACT).alias("hours")
    )


def landed_month_hours(entries_q: DataFrame) -> DataFrame:
    """A2 of a report, landed once in the shared checkpoint folder: the month
    rows, transfers, future hours, coworkers and budget keys all read it, so the
    entries are scanned and joined once per report instead of once per branch."""
    from ..session import materialize

    return materialize(month_hours(entries_q), "month-hours")


def landed_day_hours(entries: DataFrame) -> DataFrame:
    """Hours per (employee, day, project, milestone), landed: what every time block
    of a flexible report is rolled up from."""
    from ..session import materialize

    return materialize(entries.groupBy(*report_of(entries), "staff_name", "booked_on", "month", "quarter", *ROW_KEY).agg(
        F.sum("hours").cast(S.EXACT).alias("hours")), "day-hours")


def quarter_hours(month_rows: DataFrame) -> DataFrame:
    """A3 / A10: hours per (employee, quarter, project, milestone), rolled up from A2."""
    return month_rows.groupBy(*report_of(month_rows), "staff_name", "quarter", *ROW_KEY).agg(
        F.sum("hours").cast(S.EXACT).alias("hours")
    )


def project_summary(df: DataFrame) -> DataFrame:
    """Hours per (project, employee)."""
    return df.groupBy(*report_of(df), "proj_norm", "staff_name").agg(F.sum("hours").cast(S.EXACT).alias("hours"))


def employee_summary(df: DataFrame) -> DataFrame:
    """Hours per (employee, project)."""
    return df.groupBy(*report_of(df), "staff_name", "proj_norm").agg(F.sum("hours").cast(S.EXACT).alias("hours"))


# ------------------------------------------------------------ windows (W*)

def cumulative_quarter_hours(month_rows: DataFrame) -> DataFrame:
    """An employee's hours on a key in the quarter up to and including the
    month.  Partitions are (employee, key, quarter): at most three rows each."""
    w = (
        Window.partitionBy(*report_of(month_rows), "staff_name", *ROW_KEY, "quarter")
        .orderBy("month")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return month_rows.withColumn("cum_hours", F.sum("hours").over(w).cast(S.EXACT))


def future_hours_all_staff(entries: DataFrame) -> DataFrame:
    """Per (key, month) the hours of ALL employees on that key in later
    months of the same quarter.  Pre-aggregated to (key, month) first, so the
    window sees at most three rows per key whatever the skew.  Accepts entries
    or month hours (A2): both carry hours per key and month."""
    by = report_of(entries)
    per_month = entries.groupBy(*by, *ROW_KEY, "quarter", "month").agg(F.sum("hours").alias("key_hours"))
    w = (
        Window.partitionBy(*by, *ROW_KEY, "quarter")
        .orderBy("month")
        .rowsBetween(1, Window.unboundedFollowing)
    )
    return per_month.select(
        *by, *ROW_KEY, "quarter", "month",
        F.coalesce(F.sum("key_hours").over(w), F.lit(0)).cast(S.EXACT).alias("future_hours"),
    )


# ----------------------------------------------------------- blocks (T*)

def month_blocks(df: DataFrame) -> DataFrame:
    """One block per month present; start/end = the whole calendar month."""
    return df.select(
        S.month_label("month").alias("block_name"),
        F.col("month").alias("block_start"),
        F.last_day("month").alias("block_end"),
    ).distinct()


def week_blocks(df: DataFrame) -> DataFrame:
    """T3 (D10): key = (ISO year, ISO week); start/end = first/last date present
    over all employees."""
    by = report_of(df)
    wk = df.where(F.col("booked_on").isNotNull()).groupBy(
        *by,
        F.extract(F.lit("YEAROFWEEK"), F.col("booked_on")).alias("iso_year"),
        F.weekofyear("booked_on").alias("iso_week"),
    ).agg(F.min("booked_on").alias("block_start"), F.max("booked_on").alias("block_end"))
    return wk.select(
        *by, "iso_year", "iso_week",
        S.week_label("iso_week", "block_start", "block_end").alias("block_name"),
        "block_start", "block_end",
    )


def assign_blocks(df: DataFrame, grouping: str, start: date, end: date) -> DataFrame:
    """Adds block_name, block_start, block_end to every entry.

    Blocks partition the filtered entries, so this is a projection (plus one
    aggregate join for weeks), never a union of copies (O4).
    """
    if grouping == "month":
        return df.withColumns({
            "block_name": S.month_label("month"),
            "block_start": F.col("month"),
            "block_end": F.last_day("month"),
        })
    if grouping == "week":
        keyed = df.withColumns({
            "iso_year": F.extract(F.lit("YEAROFWEEK"), F.col("booked_on")),
            "iso_week": F.weekofyear("booked_on"),
        })
        return keyed.join(week_blocks(df), [*report_of(df), "iso_year", "iso_week"])
    if grouping == "period":
        return df.withColumns({
            "block_name": S.range_label(F.lit(start), F.lit(end)),
            "block_start": F.lit(start),
            "block_end": F.lit(end),
        })
    if grouping == "none":
        return df.withColumns({
            "block_name": F.lit(K.TOTAL_BLOCK_LABEL),
            "block_start": F.lit(start),
            "block_end": F.lit(end),
        })
    raise ValueError(f"unknown time grouping {grouping!r}")
