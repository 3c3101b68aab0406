"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the
bridge tables; those that need landed inputs run jobs while they are built.  Parameters (report quarter, date range, filter lists)
are the report parameters a user would pass; they never subset the data to make
a check cheaper.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import bookings as BK
from ..session import concurrently, configure, materialize
from ..sources import bridge as BR

QUARTER = BR.REPORT_QUARTER
Q_START = S.parse_quarter(QUARTER)
RANGE = (date(1998, 1, 1), date(1998, 12, 31))
PROJECTS = ["1003", "0000 Intern", "1017.01"]
EMPLOYEES = ["Supplier#000000001", "Supplier#000000007", "Supplier#000000042"]


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    configure(spark)
    return BR.bookings(spark, sf_dir)


def project_summary(spark, sf_dir):
    return BK.project_summary(_entries(spark, sf_dir))


def employee_summary(spark, sf_dir):
    return BK.employee_summary(_entries(spark, sf_dir))


def date_range_filter(spark, sf_dir):
    e = BK.in_range(_entries(spark, sf_dir), *RANGE)
    return e.groupBy("proj_norm", "staff_name").agg(
        F.sum("hours").cast(S.HOURS).alias("hours"), F.count("*").alias("n_entries")
    )


def project_prefix_filter(spark, sf_dir):
    return BK.employee_summary(BK.projects_matching(_entries(spark, sf_dir), PROJECTS))


def employee_filter(spark, sf_dir):
    return BK.employee_summary(BK.employees_matching(_entries(spark, sf_dir), EMPLOYEES))


def project_list_filter(spark, sf_dir):
    """P6 / P7 by tables: project codes of the parts' odd brands, some cut short, and
    the employees with an even key."""
    part, supplier = BR.table(spark, sf_dir, "part"), BR.table(spark, sf_dir, "supplier")
    n = F.substring("p_brand", 7, 10).cast("int")
    code = F.when(n == 1, F.lit("0000 I")).otherwise((n + 1000).cast("string"))
    projects = part.where(n % 2 == 1).select(code.alias("prefix")).union(
        part.where(n % 10 == 4).select(F.concat((n + 1000).cast("string"), F.lit(".01 Projekt "), n.cast("string"))))
    employees = supplier.where("s_suppkey % 2 = 0").select("s_name")
    e = BK.projects_matching(_entries(spark, sf_dir), projects)
    return BK.employee_summary(BK.employees_matching(e, employees))


def exclude_special(spark, sf_dir):
    e = BK.exclude_special(_entries(spark, sf_dir))
    return e.groupBy("proj_norm").agg(
        F.sum("hours").cast(S.HOURS).alias("hours"), F.countDistinct("staff_name").alias("n_staff")
    )


def quarters_available(spark, sf_dir):
    return BK.quarters_available(_entries(spark, sf_dir))


def latest_quarter(spark, sf_dir):
    return BK.latest_quarter(_entries(spark, sf_dir))


def month_hours(spark, sf_dir):
    return BK.month_hours(BK.in_quarter(_entries(spark, sf_dir), Q_START))


def month_blocks(spark, sf_dir):
    return BK.month_blocks(BK.in_range(_entries(spark, sf_dir), *RANGE))


def week_blocks(spark, sf_dir):
    return BK.week_blocks(BK.in_range(_entries(spark, sf_dir), *RANGE))


def period_block(spark, sf_dir):
    e = BK.assign_blocks(BK.in_range(_entries(spark, sf_dir), *RANGE), "period", *RANGE)
    return e.groupBy("block_name", "block_start", "block_end", "staff_name").agg(
        F.sum("hours").cast(S.HOURS).alias("hours")
    )


def total_block(spark, sf_dir):
    e = BK.assign_blocks(BK.in_range(_entries(spark, sf_dir), *RANGE), "none", *RANGE)
    return e.groupBy("block_name", "block_start", "block_end", "proj_norm").agg(
        F.sum("hours").cast(S.HOURS).alias("hours")
    )


def cumulative_quarter_hours(spark, sf_dir):
    return BK.cumulative_quarter_hours(month_hours(spark, sf_dir))


def future_hours_all_staff(spark, sf_dir):
    return BK.future_hours_all_staff(BK.in_quarter(_entries(spark, sf_dir), Q_START))


QUERIES = {
    "project_summary": project_summary,
    "employee_summary": employee_summary,
    "date_range_filter": date_range_filter,
    "project_prefix_filter": project_prefix_filter,
    "employee_filter": employee_filter,
    "project_list_filter": project_list_filter,
    "exclude_special": exclude_special,
    "quarters_available": quarters_available,
    "latest_quarter": latest_quarter,
    "month_hours": month_hours,
    "month_blocks": month_blocks,
    "week_blocks": week_blocks,
    "period_block": period_block,
    "total_block": total_block,
    "cumulative_quarter_hours": cumulative_quarter_hours,
    "future_hours_all_staff": future_hours_all_staff,
}
FLAGSHIP = project_summary


# ------------------------------------------------------------ budget export

from ..operators import budget as BU  # noqa: E402


def _lines(spark, sf_dir):
    configure(spark)
    return BR.budget_lines(spark, sf_dir, QUARTER)


def plan_actual(spark, sf_dir):
    return BU.plan_actual(_lines(spark, sf_dir))


def ffill_project(spark, sf_dir):
    d = BU.first_pass(_lines(spark, sf_dir))
    return d.select("row_no", "pos", F.col("projekt").alias("project"), "changed", "is_top")


def parent_map(spark, sf_dir):
    return BU.parent_map(_lines(spark, sf_dir))


def _records(spark, sf_dir):
    return BU.budget_records(_lines(spark, sf_dir))


def section_target_hours(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("project", "top_norm", "lookup_id", "target_hours", "actual_hours")


def section_rates(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select("project", "top_norm", "billing",
                    *[F.round(c, 4).alias(c) for c in ("rate_sv", "rate_cad", "rate_adm")])


def nachtrag_records(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.where(S.is_supplement_package("top_milestone")).select(
        "project", "project_code", "top_milestone", "top_norm", "billing", "total_budget", "target_hours",
        F.round("rate_sv", 4).alias("rate_sv"), "lookup_id",
    )


def budget_records(spark, sf_dir):
    r = _records(spark, sf_dir)
    return r.select(
        "project", "project_code", "top_milestone", "top_norm", "billing", "total_budget", "billed", "cost",
        "target_hours", "actual_hours",
        *[F.round(c, 4).alias(c) for c in ("rate_sv", "rate_cad", "rate_adm")],
        "lookup_key", "lookup_id",
    )


def budget_overview(spark, sf_dir):
    return BU.budget_overview(_records(spark, sf_dir))


QUERIES.update({
    "plan_actual": plan_actual,
    "ffill_project": ffill_project,
    "parent_map": parent_map,
    "section_target_hours": section_target_hours,
    "section_rates": section_rates,
    "nachtrag_records": nachtrag_records,
    "budget_records": budget_records,
    "budget_overview": budget_overview,
})


# ------------------------------------------------------------ month rules

from ..operators import rules as RU  # noqa: E402


def _quarter_entries(spark, sf_dir):
    return BK.in_quarter(_entries(spark, sf_dir), Q_START)


def _plan(spark, sf_dir):
    return BU.plan_actual(_lines(spark, sf_dir))


def _mh(spark, sf_dir):
    return BK.landed_month_hours(_quarter_entries(spark, sf_dir))


def _month_rows(spark, sf_dir):
    mh, plan = concurrently(lambda: _mh(spark, sf_dir), lambda: _plan(spark, sf_dir))
    return RU.month_rows(mh, plan)


def _rows_adj(spark, sf_dir, mh=None, plan=None):
    if mh is None and plan is None:
        mh, plan = concurrently(lambda: _mh(spark, sf_dir), lambda: _plan(spark, sf_dir))
    mh = mh if mh is not None else _mh(spark, sf_dir)
    plan = plan if plan is not None else _plan(spark, sf_dir)
    return RU.landed_rows(RU.with_adjustments(RU.month_rows(mh, plan, RU.hot_keys(mh)), BR.adjustments(spark, sf_dir, QUARTER, mh)))


def month_rows(spark, sf_dir):
    return _month_rows(spark, sf_dir).drop("target_for_revenue")


def coworkers(spark, sf_dir):
    mh = _mh(spark, sf_dir)
    return RU.coworkers(mh, RU.hot_keys(mh))


def hour_transfers(spark, sf_dir):
    d = _rows_adj(spark, sf_dir)
    return d.where(F.col("adj_h").isNotNull() | (F.col("from_others") > 0)).select(
        "staff_name", "month", "proj_norm", "ms_norm", "hours", "adj_h", "assign_to", "transferable", "from_others"
    )


def _totals(spark, sf_dir):
    return RU.month_totals(_rows_adj(spark, sf_dir))


def month_totals(spark, sf_dir):
    return _totals(spark, sf_dir).select("staff_name", "month", "total_hours", "bonus_base", "special_base")


def bonus_totals(spark, sf_dir):
    return _totals(spark, sf_dir).select(
        "staff_name", "month", "bonus_base", "adj_regular", "bonus_total", "special_base", "adj_special",
        "special_total", "assigned", "total_bonus",
    )


def transfer_sheet(spark, sf_dir):
    t = _totals(spark, sf_dir)
    return t.select("staff_name", S.month_label("month").alias("month_label"), "total_hours", "bonus_total",
                    "special_total", "assigned", "total_bonus")


def _resolved(spark, sf_dir, prepared=None, mh=None):
    prepared = prepared if prepared is not None else BU.prepare(_lines(spark, sf_dir))
    recs, edges = BU.budget_scan(prepared=prepared)
    pmap = BU.parent_map_from_edges(edges)
    keys = (mh if mh is not None else _quarter_entries(spark, sf_dir)).select("proj_norm", "ms_norm")
    return RU.landed_budget(RU.resolve_budget(keys, recs, pmap))


def budget_resolve(spark, sf_dir):
    return _resolved(spark, sf_dir).select("proj_norm", "ms_norm", "res_id", "target_hours_q", "cost_s")


def lookup_id_resolve(spark, sf_dir):
    r = _resolved(spark, sf_dir)
    return r.select("proj_norm", "ms_norm", "lookup_id", "billing",
                    *[F.round(c, 4).alias(c) for c in ("rate_sv", "rate_cad", "rate_adm")], "budget_total")


def _revenue(spark, sf_dir):
    # one landed budget export feeds both the plan and the budget records
    prepared, mh = concurrently(lambda: BU.prepare(_lines(spark, sf_dir)), lambda: _mh(spark, sf_dir))
    rows, resolved = concurrently(lambda: _rows_adj(spark, sf_dir, mh, BU.plan_from_prepared(prepared)),
                                  lambda: _resolved(spark, sf_dir, prepared, mh))
    return RU.revenue_rows(rows, resolved, BR.positions(spark, sf_dir), RU.hot_keys(mh))


def revenue_rows(spark, sf_dir):
    d = _revenue(spark, sf_dir)
    return d.select(
        "staff_name", "month", "proj_norm", "ms_norm", "position", "billing",
        F.round("rate", 4).alias("rate"),
        *[F.round(c, 2).alias(c) for c in ("revenue", "possible", "lost", "revenue_key")],
    )


def revenue_by_key(spark, sf_dir):
    d = _revenue(spark, sf_dir)
    return d.groupBy("proj_norm", "ms_norm", "month").agg(
        F.round(F.sum("revenue"), 2).alias("revenue"),
        F.round(F.sum("possible"), 2).alias("possible"),
        F.count("*").alias("n_rows"),
    )


def month_revenue_totals(spark, sf_dir):
    d = RU.revenue_totals(_revenue(spark, sf_dir), "month")
    return d.select("staff_name", "quarter", "month", *[F.round(c, 2).alias(c) for c in MONEY])


def quarter_milestones(spark, sf_dir):
    return RU.quarter_milestones(BK.month_hours(_quarter_entries(spark, sf_dir)), _plan(spark, sf_dir))


def quarter_summary(spark, sf_dir):
    plan = _plan(spark, sf_dir)
    return RU.quarter_summary(_rows_adj(spark, sf_dir, plan=plan), plan)


MONEY = ("revenue", "possible", "lost", "revenue_key")


def quarter_revenue_totals(spark, sf_dir):
    d = RU.revenue_totals(_quarter_revenue(spark, sf_dir))
    return d.select("staff_name", "quarter", *[F.round(c, 2).alias(c) for c in MONEY])


def _quarter_revenue(spark, sf_dir):
    prepared, mh = concurrently(lambda: BU.prepare(_lines(spark, sf_dir)), lambda: _mh(spark, sf_dir))
    plan = BU.plan_from_prepared(prepared)
    rows, resolved = concurrently(lambda: _rows_adj(spark, sf_dir, mh, plan),
                                  lambda: _resolved(spark, sf_dir, prepared, mh))
    hot = RU.hot_keys(mh)
    return RU.quarter_revenue(RU.quarter_summary(rows, plan, hot), resolved, BR.positions(spark, sf_dir), hot)


def quarter_revenue(spark, sf_dir):
    d = _quarter_revenue(spark, sf_dir)
    return d.select(
        "staff_name", "quarter", "proj_norm", "ms_norm", "position", "billing",
        F.round("rate", 4).alias("rate"),
        *[F.round(c, 2).alias(c) for c in ("revenue", "possible", "lost", "revenue_key")],
    )


def quarter_totals(spark, sf_dir):
    return RU.quarter_totals(_totals(spark, sf_dir))


QUERIES.update({
    "month_rows": month_rows,
    "coworkers": coworkers,
    "hour_transfers": hour_transfers,
    "month_totals": month_totals,
    "bonus_totals": bonus_totals,
    "transfer_sheet": transfer_sheet,
    "budget_resolve": budget_resolve,
    "lookup_id_resolve": lookup_id_resolve,
    "revenue_rows": revenue_rows,
    "revenue_by_key": revenue_by_key,
    "quarter_milestones": quarter_milestones,
    "quarter_summary": quarter_summary,
    "quarter_totals": quarter_totals,
    "quarter_revenue": quarter_revenue,
    "month_revenue_totals": month_revenue_totals,
    "quarter_revenue_totals": quarter_revenue_totals,
})
FLAGSHIP = month_rows


# ------------------------------------------------------------ reports

from . import reports as RP  # noqa: E402

FLEX_MONTH = RP.ReportConfig("custom_period", date(1998, 7, 1), date(1998, 12, 31), "month")
FLEX_WEEK = RP.ReportConfig("custom_period", date(1998, 7, 1), date(1998, 12, 31), "week")
FLEX_PERIOD = RP.ReportConfig("custom_period", date(1998, 7, 1), date(1998, 12, 31), "period",
                              exclude_special_projects=True)


def _per_file(spark, sf_dir):
    """Landed month rows with adjustments of three time files, a report each."""
    entries = BK.in_quarter(RP.per_file(BR.bookings(configure(spark), sf_dir, files=3)), Q_START)
    mh, plan = concurrently(lambda: BK.landed_month_hours(entries), lambda: _plan(spark, sf_dir))
    return _rows_adj(spark, sf_dir, mh, plan)


def per_file_report(spark, sf_dir):
    """The bonus totals of one report per time file, in one plan."""
    return RU.month_totals(_per_file(spark, sf_dir)).select(
        "report", "staff_name", "month", "bonus_base", "adj_regular", "bonus_total", "special_base", "adj_special",
        "special_total", "assigned", "total_bonus")


def per_file_month_rows(spark, sf_dir):
    return _per_file(spark, sf_dir).select(
        "report", "staff_name", "quarter", "month", "proj_norm", "ms_norm", "milestone_type", "is_special", "hours", "soll", "ist",
        "pct", "eligible", "status")


def cover_months(spark, sf_dir):
    mh, plan = concurrently(lambda: _mh(spark, sf_dir), lambda: _plan(spark, sf_dir))
    return RP.cover_months(RU.month_totals(_rows_adj(spark, sf_dir, mh, plan)), mh.select("month").distinct())


def _adjustments(spark, sf_dir):
    """The adjustments as an input table: from landed hours, landed."""
    return materialize(BR.adjustments(spark, sf_dir, QUARTER, _mh(spark, sf_dir)), "adjustments")


def month_rows_one_employee(spark, sf_dir):
    """A report for one employee has the numbers over all staff."""
    cfg = RP.ReportConfig("quarterly", Q_START, date(1998, 9, 30), "monthly", employees=EMPLOYEES[:1])
    d = RP.generate(cfg, _entries(spark, sf_dir), _lines(spark, sf_dir), _adjustments(spark, sf_dir),
                    BR.positions(spark, sf_dir))["month_rows"]
    return d.select("staff_name", "month", "proj_norm", "ms_norm", "hours", "soll", "ist", "pct", "eligible", "from_others",
                    F.round("revenue", 2).alias("revenue"), F.round("revenue_key", 2).alias("revenue_key"))


def cover_quarter(spark, sf_dir):
    return RP.cover_quarter(RU.quarter_totals(_totals(spark, sf_dir)))


def quarter_employees(spark, sf_dir):
    return RP.quarter_employees(_quarter_entries(spark, sf_dir))


def _flex(spark, sf_dir, cfg):
    """Flexible rows, landed; the adjustments are those of the landed hours."""
    e = RP.filtered_entries(_entries(spark, sf_dir), cfg)
    (plan, records, pmap, _), daily = concurrently(lambda: RP.budget_of(_lines(spark, sf_dir)), lambda: BK.landed_day_hours(e))
    hours = BK.month_hours(BK.in_quarter(daily, Q_START)).withColumn("hours", F.col("hours").cast(S.HOURS))
    adjustments, resolved = concurrently(
        lambda: materialize(BR.adjustments(spark, sf_dir, QUARTER, materialize(hours, "flex-months")), "flex-adjustments"),
        lambda: RU.landed_budget(RU.resolve_budget(daily.select(*RU.KEY), records, pmap)))
    return RU.landed_rows(RP.flex_rows(daily, plan, cfg, adjustments, lambda keys: resolved))


def flex_rows(spark, sf_dir):
    return _flex(spark, sf_dir, FLEX_MONTH)


def flex_period_rows(spark, sf_dir):
    return _flex(spark, sf_dir, FLEX_PERIOD)


def flex_block_totals(spark, sf_dir):
    return RP.flex_block_totals(_flex(spark, sf_dir, FLEX_WEEK))


def flex_summary(spark, sf_dir):
    return RP.flex_summary(RP.flex_block_totals(_flex(spark, sf_dir, FLEX_MONTH)))


QUERIES.update({
    "per_file_report": per_file_report,
    "per_file_month_rows": per_file_month_rows,
    "cover_months": cover_months,
    "cover_quarter": cover_quarter,
    "month_rows_one_employee": month_rows_one_employee,
    "quarter_employees": quarter_employees,
    "flex_rows": flex_rows,
    "flex_period_rows": flex_period_rows,
    "flex_block_totals": flex_block_totals,
    "flex_summary": flex_summary,
})


# ------------------------------------------------------------ scalar functions over test columns

# Fixed values of the test texts: German month abbreviations (January first);
# four of them are not English tokens and parse as January.
GERMAN_MONTH_TOKENS = ["Jan", "Feb", "Mär", "Apr", "Mai", "Jun", "Jul", "Aug", "Sep", "Okt", "Nov", "Dez"]
MS_PREFIXES = ["• ", "● ", "- ", " -• "]


def _lineitem(spark, sf_dir):
    configure(spark)
    return BR.table(spark, sf_dir, "lineitem")


def de_number_parse(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    german = F.translate(F.format_number(F.col("l_extendedprice").cast(S.HOURS), 2), ",.", ".,")
    key = F.col("l_orderkey").cast("string")
    text = (F.when(F.col("l_linenumber") == 7, F.concat(F.lit("x"), key))
            .when(F.col("l_linenumber") == 6, F.concat(key, F.lit(",125")))  # three decimals
            .when(F.col("l_linenumber") == 5, F.concat(F.lit("9" * 23), key))  # too long for a number
            .otherwise(german))
    return li.select("l_orderkey", "l_linenumber", text.alias("text")).withColumn("value", S.de_number("text"))


def milestone_norm(spark, sf_dir):
    li = _lineitem(spark, sf_dir).select("l_partkey", "l_linenumber")
    part = BR.table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    prefix = F.element_at(F.array(*[F.lit(p) for p in MS_PREFIXES]), (F.col("l_linenumber") % 4 + 1).cast("int"))
    n = F.substring("p_brand", 7, 10).cast("int")
    raw = F.concat(prefix, BR.milestone_name(n, F.col("p_type")))
    d = li.join(part, li.l_partkey == part.p_partkey).select(raw.alias("raw")).distinct()
    return d.withColumn("ms_norm", S.norm_milestone("raw"))


def _milestones(spark, sf_dir):
    return _entries(spark, sf_dir).select("ms_norm").distinct()


def milestone_type(spark, sf_dir):
    return _milestones(spark, sf_dir).withColumn("milestone_type", S.milestone_type("ms_norm"))


def budget_from_name(spark, sf_dir):
    return _milestones(spark, sf_dir).select(
        "ms_norm", S.name_budget_hours("ms_norm").alias("hours"), S.name_budget_unit("ms_norm").alias("unit"))


def billing_type(spark, sf_dir):
    lines = _lines(spark, sf_dir)
    return lines.select(
        "row_no", "package", "flag",
        S.billing_type(F.col("package"), F.col("flag")).alias("billing"),
        S.billing_type(F.col("package"), F.col("flag"), force=True).alias("billing_forced"),
        S.is_supplement_package("package").alias("is_supplement"),
    )


def date_parse(spark, sf_dir):
    li = _lineitem(spark, sf_dir)
    d = F.col("l_shipdate").cast("date")
    en = F.element_at(F.array(*[F.lit(t) for t in S.K.ENGLISH_MONTH_TOKENS]), F.month(d))
    de = F.element_at(F.array(*[F.lit(t) for t in GERMAN_MONTH_TOKENS]), F.month(d))
    token = F.when(F.col("l_linenumber") == 3, de).otherwise(en)
    day = F.when(F.col("l_linenumber") == 6, F.lit("31")).otherwise(F.lpad(F.dayofmonth(d).cast("string"), 2, "0"))
    text = F.concat(F.date_format(d, "EEE"), F.lit(", "), day, F.lit(" "), token, F.lit(" "),
                    F.year(d).cast("string"), F.lit(" 00:00:00 +0200"))
    return li.select("l_orderkey", "l_linenumber", text.alias("text")).withColumns({
        "booked_on": S.booking_date("text"),
        "month_unknown": S.month_token_unknown("text"),
    })


QUARTER_FORMATS = ["Q{k}-{y}", "Q{k}/{y}", "Q{k}{y}", "Q{k} {y}", "{y}Q{k}", "{y}-Q{k}", "{y}/Q{k}", "{y} q{k}",
                   "Q{b}-{y}"]


def quarter_parse(spark, sf_dir):
    q = _entries(spark, sf_dir).select("quarter").distinct()
    y = F.year("quarter").cast("string")
    k = F.quarter("quarter").cast("string")
    b = (F.quarter("quarter") + 4).cast("string")
    texts = []
    for f in QUARTER_FORMATS:
        parts, rest = [], f
        while rest:
            i = rest.find("{")
            if i < 0:
                parts.append(F.lit(rest))
                break
            if i:
                parts.append(F.lit(rest[:i]))
            tok = rest[i + 1]
            parts.append({"k": k, "y": y, "b": b}[tok])
            rest = rest[i + 3:]
        texts.append(F.concat(*parts))
    return q.select(F.explode(F.array(*texts)).alias("text")).withColumn("quarter", S.quarter_of_text("text"))


def project_keys(spark, sf_dir):
    p = _entries(spark, sf_dir).select("proj_norm").distinct()
    return p.select("proj_norm", F.posexplode(S.project_keys("proj_norm")).alias("kpos", "project_key"))


def status_band(spark, sf_dir):
    p = plan_actual(spark, sf_dir)
    return p.select("proj_norm", "ms_norm", "pct", S.status_band("pct").alias("status"))


def month_label(spark, sf_dir):
    m = _entries(spark, sf_dir).select("month").distinct()
    return m.withColumn("month_label", S.month_label("month"))


QUERIES.update({
    "de_number_parse": de_number_parse,
    "milestone_norm": milestone_norm,
    "milestone_type": milestone_type,
    "budget_from_name": budget_from_name,
    "billing_type": billing_type,
    "date_parse": date_parse,
    "quarter_parse": quarter_parse,
    "project_keys": project_keys,
    "status_band": status_band,
    "month_label": month_label,
})
FLAGSHIP = month_rows


import dataclasses  # noqa: E402
import uuid  # noqa: E402

from pyspark.sql import Window  # noqa: E402

from .. import sinks as SI  # noqa: E402
from ..functions import constants as K  # noqa: E402
from ..session import run_folder  # noqa: E402
from ..sources import files as FI  # noqa: E402
from ..sources import landed as LA  # noqa: E402


def _booking_cells(spark, sf_dir):
    """lineitem's columns, staff_name and the bookings as cells of a row; hours as
    thirds, too many digits, a German comma and an exponent, purposes with CDATA and
    entities; ``nested`` is a row inside the row."""
    e = BR.table(spark, sf_dir, "lineitem")
    configure(spark)
    supp = BR.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    ln = F.col("l_linenumber")
    quarter_hours = (F.col("l_quantity") * F.lit(0.25)).cast(S.HOURS).cast("string")
    number = (F.when(ln == 1, F.lit("0.3333333")).when(ln == 2, F.lit("0.125")).when(ln == 3, F.lit("8,00"))
              .when((ln == 7) & (F.col("l_orderkey") % 100 == 0), F.lit("1e20")).when(ln == 6, F.lit(" 1e0 ")).otherwise(quarter_hours))
    purpose = (F.when(ln == 4, F.lit("<![CDATA[a <row> & </row> b]]>")).when(ln == 5, F.lit("x &ndash; y &shy;"))
               .otherwise(F.lit("&lt;plain&gt;")))
    cell = lambda name, v: F.concat(F.lit(f'<cell name="{name}" type="text">'), v, F.lit("</cell>\n"))
    d = F.col("l_shipdate").cast("date")
    date_text = F.concat(F.date_format(d, "EEE, dd "), F.element_at(F.array(*[F.lit(t) for t in S.K.ENGLISH_MONTH_TOKENS]), F.month(d)),
                         F.date_format(d, " yyyy"), F.lit(" 00:00:00 +0200"))
    cells = lambda number, purpose: F.concat(
        cell("purpose", purpose), cell("staff_name", F.col("s_name")), cell("work_package_name", F.lit("• 1.1 Paket")),
        cell("date", date_text), cell("number", number), cell("project", F.lit(" 1234.01 Beispiel ")))
    return e.join(supp, e.l_suppkey == supp.s_suppkey).withColumns({
        "body": cells(number, purpose), "nested": F.when(ln == 2, cells(F.lit("0.25"), F.lit("inner")))})


XML_PROLOG = "<!DOCTYPE x [<!ENTITY ndash '&#8211;'>]>"


def _entry_totals(parsed):
    return parsed.groupBy("staff_name", "quarter", "proj_norm", "ms_norm").agg(
        F.sum("hours").cast(S.EXACT).alias("hours"), F.count("*").alias("n_entries"), F.min("purpose").alias("first_purpose"),
        F.max("purpose").alias("last_purpose"))


def xml_entries(spark, sf_dir):
    """The bookings as row texts, parsed again."""
    rows = _booking_cells(spark, sf_dir).select("body")
    document = F.concat(F.lit(XML_PROLOG + "<data>"), F.col("body"), F.lit("</data>"))
    return _entry_totals(FI.parse_rows(rows.select(
        F.lit("lineitem").alias("source_file"), FI.declared_entities(document).alias("declared"), FI._plain_cdata(F.col("body")).alias("body"))))


ROWS_A_FILE = 100_000


def _written(lines, name, *order):
    """Files of lines: those of a ``part`` in one file, in the given order."""
    path = f"{run_folder(lines.sparkSession)}/{name}-{uuid.uuid4().hex}"
    lines.repartition("part").sortWithinPartitions("part", *order).select("part", "value").write.partitionBy("part").text(path)
    return path


def xml_documents(spark, sf_dir):
    """The bookings written as XML documents of up to about 100,000 rows and
    read again: comments and CDATA that hold tags, rows within rows, entities of the
    prolog."""
    d = _booking_cells(spark, sf_dir)
    n = max(1, -(-BR.table(spark, sf_dir, "lineitem").count() // ROWS_A_FILE))
    part = F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(n))
    nested = F.coalesce(F.concat(F.lit("<group>\n<row>"), F.col("nested"), F.lit("</row>\n</group>")), F.lit(""))
    comment = F.when(F.col("l_linenumber") == 3, F.lit("<!-- <row> a > b -->\n")).otherwise(F.lit(""))
    rows = d.select(part.alias("part"), F.lit(1).alias("kind"), F.concat(
        comment, F.lit("<row id='a>b'>"), nested, F.col("body"), F.lit("</row>")).alias("value"))
    ends = spark.range(n).select(F.col("id").alias("part"), F.inline(F.array(
        F.struct(F.lit(0).alias("kind"), F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n{XML_PROLOG}<data>').alias("value")),
        F.struct(F.lit(2).alias("kind"), F.lit("<row/></data>").alias("value")))))
    path = _written(rows.unionByName(ends), "xml-documents", "kind")
    return _entry_totals(FI.read_time_xml(spark, f"{path}/part=*"))


def landed_month_hours(spark, sf_dir):
    """A2 kept up: the bookings landed as four files, the last two after the first
    month hours were made; then a file again with less in it."""
    entries = BR.bookings(configure(spark), sf_dir, files=4)
    base = f"{run_folder(spark)}/landed-{uuid.uuid4().hex}"
    early = entries.where("source_file in ('times-0', 'times-1')")
    LA.land(early, f"{base}/entries", f"{base}/hours")
    LA.land(entries.where("source_file in ('times-2', 'times-3')"), f"{base}/entries", f"{base}/hours")
    LA.land(entries.where("source_file = 'times-1' and month < date'2001-01-01'"), f"{base}/entries", f"{base}/hours")
    return spark.read.parquet(f"{base}/hours").select("staff_name", "quarter", "month", "proj_norm", "ms_norm", "hours")


def landed_latest_quarter(spark, sf_dir):
    """O2 / A7 over landed entries, from the folders' names."""
    base = f"{run_folder(spark)}/landed-{uuid.uuid4().hex}"
    LA.land_entries(BR.bookings(configure(spark), sf_dir), base)
    return LA.latest_quarter(spark, base)


def bad_value_account(spark, sf_dir):
    """Rows of bookings with German month names, missing cells and
    hours that are no numbers, counted by reason."""
    e = _lineitem(spark, sf_dir)
    cell = lambda name, v, when=None: F.coalesce(F.when(F.lit(True) if when is None else when, F.concat(
        F.lit(f'<cell name="{name}">'), v, F.lit("</cell>"))), F.lit(""))
    key, ln, d = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_shipdate").cast("date")
    token = F.element_at(F.array(*[F.lit(t) for t in GERMAN_MONTH_TOKENS]), F.month(d))
    day = F.when(ln == 6, F.lit("31")).otherwise(F.date_format(d, "dd"))
    number = F.when(ln == 3, F.lit("8,00")).when(ln == 2, F.lit("")).when((ln == 1) & (key % 5 == 0), F.lit("1e99")).otherwise(F.lit("1.5"))
    body = F.when(key % 17 == 0, F.lit("")).otherwise(F.concat(
        cell("staff_name", F.when(key % 11 == 0, F.lit(" ")).otherwise(F.lit("A"))), cell("work_package_name", F.lit("x"), key % 7 != 0),
        cell("date", F.concat_ws(" ", day, token, F.date_format(d, "yyyy")), key % 13 != 0), cell("number", number)))
    none = F.array().cast("array<struct<name:string,value:string>>")
    rows = e.select(F.concat(F.lit("times-"), (key % 3).cast("string")).alias("source_file"), none.alias("declared"), body.alias("body"))
    return FI.entry_account(FI.row_cells(rows))


def report_requests(spark, sf_dir):
    """The orders as requests for reports: their filter lists, what is
    wrong with their ranges, and the names of the results."""
    configure(spark)
    start = F.col("o_orderdate").cast("date")
    d = BR.table(spark, sf_dir, "orders").select(
        "o_orderkey", start.alias("start"), F.date_add(start, (F.col("o_custkey") % 120 - 3).cast("int")).alias("end"),
        (F.col("o_orderkey") % 2 == 0).alias("quarterly"),
        F.when(F.col("o_custkey") % 5 != 0, F.concat(F.lit(" "), F.col("o_orderstatus"), F.lit(" ,, "), F.col("o_orderpriority"))).alias("text"))
    return d.select("o_orderkey", F.array_join(S.list_items("text"), "|").alias("items"), S.range_problem("start", "end", "quarterly").alias("problem"),
                    S.report_label("start", "end", "quarterly").alias("name"))


def flex_without_bonus(spark, sf_dir):
    """The component flags of the flexible report."""
    cfg = dataclasses.replace(FLEX_WEEK, include_bonus_calc=False, include_summary_sheet=False, include_budget_overview=False)
    tables = RP.generate(cfg, _entries(spark, sf_dir), _lines(spark, sf_dir), _adjustments(spark, sf_dir), BR.positions(spark, sf_dir))
    if set(tables) & {"flex_summary", "budget_overview"} or "adj_h" in tables["flex_rows"].columns:
        raise AssertionError("a table that was not asked for")
    return tables["flex_block_totals"]


def _back(spark, path, fmt, *of):
    """Written rows with their place in the files, in the order of the files' names."""
    d = spark.read.format(fmt).option("header", True).load(path)
    return _placed(d.select("*", F.col("_metadata.file_name"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("at")), *of)


def _placed(d, *of):
    place = ["file_name", "file_block_start", "at"]
    return d.withColumn("place", F.row_number().over(Window.partitionBy(*of).orderBy(*place))).drop(*place)


def employee_export(spark, sf_dir):
    """K1 / K2 / O1: the month sheets written per employee, sorted over files of 500
    rows, and read again in the files' order."""
    rows = S.rounded(_rows_adj(spark, sf_dir))
    path = f"{run_folder(spark)}/export-{uuid.uuid4().hex}"
    sheets = SI.write_employee_export(rows, path, totals=S.rounded(RU.month_totals(rows)), rows_per_file=500)
    columns = ", ".join(f"`{c}` string" for c in ("month", *(c for _, c in SI.EXPORT_COLUMNS)))
    d = _placed(SI.read_sheets(spark, path, sheets, "csv", columns), "staff_name")
    return d.select("staff_name", "place", F.col("month").cast("date").alias("month"), F.col("Projekt").alias("proj_norm"),
                    F.col("Meilenstein").alias("ms_norm"), *[F.col(f"`{c}`").cast(S.HOURS).alias(n) for n, c in SI.EXPORT_COLUMNS
                                                             if n in ("soll", "hours", "adj_h")])


def overview_table(spark, sf_dir):
    """K3 / O1: the budget overview written in its order and read again."""
    path = f"{run_folder(spark)}/overview-{uuid.uuid4().hex}"
    SI.write_table(S.rounded(BU.budget_overview(BU.budget_records(_lines(spark, sf_dir)))), path, order=SI.SORTED["budget_overview"])
    return _back(spark, path, "parquet").select("place", "lookup_id", "project", "top_milestone", "status", "remark", "available")


def cover_table(spark, sf_dir):
    """K4 / O1: the cover written in its order and read again."""
    path = f"{run_folder(spark)}/cover-{uuid.uuid4().hex}"
    SI.write_table(S.rounded(cover_months(spark, sf_dir)), path, order=SI.SORTED["cover_months"])
    return _back(spark, path, "parquet")


FILLERS = 130  # columns between the named ones


def budget_csv(spark, sf_dir):
    """The budget export written as a file of over a hundred columns,
    with an alias for the project column and quoted fields over several lines, and
    read again as the uploaded one."""
    configure(spark)
    lines = BR.budget_lines(spark, sf_dir, QUARTER)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    package = F.when(F.col("package").endswith("Position"), F.concat(
        F.lit('"'), F.col("package"), F.lit(' ""lang""\t\n\nTeil"'))).otherwise(text("package"))
    fill = "\t" + "\t".join(['5"'] + ["y"] * (FILLERS - 1)) + "\t"
    rows = lines.select(F.lit(0).alias("part"), F.col("row_no").alias("at"), F.concat(
        F.concat_ws("\t", text("projekte"), text("flag"), package, text("soll_txt"), text("ist_txt")), F.lit(fill),
        F.concat_ws("\t", text("budget_txt"), text("sollhonorar_txt"), text("billed_txt"), text("cost_txt"))).alias("value"))
    names = ["\u200bProjektname ", K.COL_FLAG, K.COL_PACKAGE, K.COL_TARGET_HOURS, K.COL_ACTUAL_HOURS,
             *[f"x{i}" for i in range(FILLERS)], K.COL_BUDGET, K.COL_TARGET_FEE, K.COL_BILLED_FEE, K.COL_COST]
    head = spark.range(1).select(F.lit(0).alias("part"), F.lit(-1).cast("long").alias("at"), F.lit("\t".join(names)).alias("value"))
    path = _written(rows.unionByName(head), "budget-export", "at")
    back = FI.budget_source(spark, f"{path}/part=0", f"{path}/no-central-export")
    return back.select((F.col("row_no") - 1).alias("line"), *FI.INTERNAL.values())


QUERIES.update({"xml_entries": xml_entries, "xml_documents": xml_documents, "budget_csv": budget_csv,
                "landed_month_hours": landed_month_hours, "landed_latest_quarter": landed_latest_quarter,
                "bad_value_account": bad_value_account, "report_requests": report_requests, "flex_without_bonus": flex_without_bonus,
                "employee_export": employee_export, "overview_table": overview_table, "cover_table": cover_table})


def _output(query):
    return lambda spark, sf_dir: S.rounded(query(spark, sf_dir))


# hours and money are exact inside and rounded here
QUERIES = {name: _output(query) for name, query in QUERIES.items()}
FLAGSHIP = QUERIES["month_rows"]
