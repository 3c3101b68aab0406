"""Report plans: the standard quarterly report, the flexible report over time
blocks, and the project / employee summaries, each returned as a dict of lazy
DataFrames (one per sheet of the reference's workbook).  ``generate`` is the
dispatch (P13).  Building a report lands its inputs (Spark jobs); the DataFrames
it returns are lazy over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..operators import bookings as BK
from ..operators import budget as BU
from ..operators import rules as RU
from ..session import concurrently
from ..sources.files import budget_account, require_rows

REPORT_TYPES = ("quarterly", "custom_period", "monthly", "yearly", "project", "employee")
GROUPINGS = ("month", "period", "week", "none")
ROWS_A_TASK = 50_000  # day hours that a task of a flexible report holds
# The names the API has for them.
GROUPING_ALIASES = {"monthly": "month", "weekly": "week"}


@dataclass
class ReportConfig:
    """Parameters of one report (RC).  Checks follow the reference (P10)."""

    report_type: str
    start_date: date
    end_date: date
    time_grouping: str = "month"
    projects: list[str] | DataFrame = field(default_factory=list)  # values, or a table's first column
    employees: list[str] | DataFrame = field(default_factory=list)
    include_bonus_calc: bool = True
    include_budget_overview: bool = True
    include_summary_sheet: bool = True
    include_quarterly_summary: bool = True  # parsed, never read (C5)
    exclude_special_projects: bool = False
    snap: bool = False  # D9: round the range to whole months / quarters / years (the guide's promise)

    def __post_init__(self):
        if self.report_type not in REPORT_TYPES:
            raise ValueError(f"unknown report type {self.report_type!r}")
        self.time_grouping = GROUPING_ALIASES.get(self.time_grouping, self.time_grouping)
        if self.time_grouping not in GROUPINGS:
            raise ValueError(f"unknown time grouping {self.time_grouping!r}")
        # filter lists may come as comma-separated text
        if isinstance(self.projects, str):
            self.projects = S.split_list(self.projects)
        if isinstance(self.employees, str):
            self.employees = S.split_list(self.employees)
        if self.snap:
            self.start_date, self.end_date = snap_range(self.report_type, self.start_date, self.end_date)
        BK.check_range(self.start_date, self.end_date, quarterly=self.report_type == "quarterly")


def snap_range(report_type: str, start: date, end: date) -> tuple[date, date]:
    """D9 (optional): monthly -> whole months, quarterly -> whole quarters,
    yearly -> whole years; other types unchanged."""
    def month_end(d: date) -> date:
        nxt = date(d.year + d.month // 12, d.month % 12 + 1, 1)
        return date.fromordinal(nxt.toordinal() - 1)

    if report_type == "monthly":
        return date(start.year, start.month, 1), month_end(end)
    if report_type == "quarterly":
        qs = date(start.year, 3 * ((start.month - 1) // 3) + 1, 1)
        return qs, month_end(date(end.year, 3 * ((end.month - 1) // 3) + 3, 1))
    if report_type == "yearly":
        return date(start.year, 1, 1), date(end.year, 12, 31)
    return start, end


def report_name(cfg: ReportConfig | None = None, quarter: date | None = None, prefix: str = "") -> str:
    """K5: 'Q3-2025' for a quarter, 'Report_<start>-<end>' otherwise."""
    if quarter is not None:
        name = f"Q{(quarter.month - 1) // 3 + 1}-{quarter.year}"
    else:
        name = f"Report_{cfg.start_date:%Y%m%d}-{cfg.end_date:%Y%m%d}"
    return f"{prefix}_{name}" if prefix else name


def filtered_entries(entries: DataFrame, cfg: ReportConfig, by_employee: bool = True) -> DataFrame:
    """P5-P8 in the reference's order; without P7 where numbers over all staff
    follow (D20)."""
    e = BK.in_range(entries, cfg.start_date, cfg.end_date)
    e = BK.projects_matching(e, cfg.projects)
    if by_employee:
        e = BK.employees_matching(e, cfg.employees)
    if cfg.exclude_special_projects:
        e = BK.exclude_special(e)
    return e


# ------------------------------------------------------------ standard

def cover_months(totals: DataFrame, months: DataFrame) -> DataFrame:
    """Per month of the report, sums over employees; a month nobody booked
    gives zeros.  ``months`` is a one-column (month) DataFrame."""
    report = BK.report_of(totals, months)
    g = totals.groupBy(*report, "month").agg(
        F.sum("total_hours").alias("total_hours"),
        F.sum("bonus_total").alias("bonus_total"),
        F.sum("special_total").alias("special_total"),
    )
    zero = F.lit(0).cast(S.EXACT)
    return months.join(g, [*report, "month"], "left").select(
        *report, "month", S.month_label("month").alias("month_label"),
        *[F.coalesce(F.col(c), zero).cast(S.EXACT).alias(c) for c in ("total_hours", "bonus_total", "special_total")],
    )


def cover_quarter(qtotals: DataFrame) -> DataFrame:
    """Quarter totals over all employees (one row per quarter) and their
    number; the employee list itself is ``quarter_employees``."""
    return qtotals.groupBy(*BK.report_of(qtotals), "quarter").agg(
        F.sum("total_hours").cast(S.EXACT).alias("total_hours"),
        F.sum("bonus_total").cast(S.EXACT).alias("bonus_total"),
        F.sum("special_total").cast(S.EXACT).alias("special_total"),
        F.countDistinct("staff_name").alias("n_employees"),
    )


def quarter_employees(entries_q: DataFrame) -> DataFrame:
    """Distinct employees of the report (sort on output)."""
    return entries_q.select(*BK.report_of(entries_q), "staff_name").distinct()


def standard_report(entries_q: DataFrame, lines: DataFrame, adjustments: DataFrame, positions: DataFrame,
                    months: DataFrame | None, include_budget_overview: bool = True,
                    employees: list[str] | DataFrame | None = None) -> dict[str, DataFrame]:
    """The quarterly report: month rows with revenue (K1), month totals and the
    hand-over table (B12), revenue totals (A6), quarter milestones, quarter summary
    and totals, cover (C1, C2), budget overview (K3).

    Future hours, transfers and the revenue per key count all staff; the employees
    asked for are picked from the finished rows (D20).  Without ``months`` the
    cover has the months of the landed hours."""
    # the budget export and the bookings are independent: land both at once
    prepared, mh = concurrently(lambda: BU.prepare(lines), lambda: BK.landed_month_hours(entries_q))
    plan, hot = BU.plan_from_prepared(prepared), RU.hot_keys(mh)
    rows, (records, edges) = concurrently(
        lambda: RU.landed_rows(RU.with_adjustments(RU.month_rows(mh, plan, hot), adjustments)),
        lambda: BU.budget_scan(prepared=prepared),
    )
    pmap = BU.parent_map_from_edges(edges)
    resolved = RU.landed_budget(RU.resolve_budget(mh.select(*RU.KEY), records, pmap))
    own = lambda d: BK.employees_matching(d, [] if employees is None else employees)
    detail = own(RU.revenue_rows(rows, resolved, positions, hot))
    totals = RU.month_totals(own(rows))
    qtotals = RU.quarter_totals(totals)
    qsummary = own(RU.quarter_revenue(RU.quarter_summary(rows, plan, hot), resolved, positions, hot))
    out = {
        "month_rows": detail,
        "month_totals": totals,
        "month_revenue_totals": RU.revenue_totals(detail, "month"),
        "quarter_milestones": RU.quarter_milestones(own(mh), plan, hot),
        "quarter_summary": qsummary,
        "quarter_revenue_totals": RU.revenue_totals(qsummary),
        "quarter_totals": qtotals,
        "cover_months": cover_months(totals, mh.select(*BK.report_of(mh), "month").distinct() if months is None else months),
        "cover_quarter": cover_quarter(qtotals),
        "employees": quarter_employees(own(mh)),
        "budget_account": budget_account(prepared),
    }
    if include_budget_overview:
        out["budget_overview"] = BU.budget_overview(records)
    return {name: S.rounded(d) for name, d in out.items()}


# ------------------------------------------------------------ flexible

def flex_rows(daily: DataFrame, plan: DataFrame, cfg: ReportConfig, adjustments: DataFrame,
              resolved) -> DataFrame:
    """B18 / B19 per (employee, block, key): prorated monthly budgets and whole-
    quarter hours for the shared special milestones, plan values otherwise (no
    roll-back, no name extraction), billing type by J3 (D14) and the user's
    adjustment.  ``resolved`` makes the budget resolution of given keys.

    ``daily`` has the hours per employee, day and key (landed once); blocks, weeks
    and quarters are rolled up from that.  An adjustment of a month stands in the last
    block in which the employee booked on the key in that month.

    Adjustments and quarter hours grow with the bookings, so they are merged, never
    broadcast: the landed hours are a small file for their rows and would pass as a
    small table.  Sorts take memory by the rows of a task, so rows are dealt to as many
    tasks as their number asks for."""
    e = BK.assign_blocks(daily, cfg.time_grouping, cfg.start_date, cfg.end_date)
    if cfg.exclude_special_projects:  # P9, second pass
        e = e.where(~S.is_special_project("proj_norm"))
    blocks, report = ["block_name", "block_start", "block_end"], BK.report_of(daily)
    n = daily.count() // ROWS_A_TASK + 1
    dealt = lambda d, *by: d.repartition(n, *by) if n > 1 else d
    e = dealt(e, *report, "staff_name", *RU.KEY)
    bh = e.groupBy(*report, "staff_name", *blocks, *RU.KEY).agg(F.sum("hours").cast(S.EXACT).alias("hours"))
    # Whole-quarter hours of the filtered data, per employee and key
    qh = e.groupBy(*report, "staff_name", *RU.KEY, F.col("quarter").alias("block_quarter")).agg(
        F.sum("hours").cast(S.EXACT).alias("quarter_hours"))
    p = plan.select(*RU.KEY, F.col("soll").alias("csv_soll"), F.col("ist").alias("csv_ist"))
    who = [*report, "staff_name", *RU.KEY]
    given = [*BK.report_of(daily, adjustments), "staff_name", *RU.KEY, "month"]
    adj = adjustments.groupBy(*given).agg(F.sum("adj_h").cast(S.EXACT).alias("adj_h"))
    last = e.groupBy(*who, "month").agg(F.max("block_start").alias("block_start"))
    adj = adj.join(dealt(last, *given).hint("merge"), given).groupBy(*who, "block_start").agg(F.sum("adj_h").cast(S.EXACT).alias("adj_h"))
    billing = resolved(bh.select(*RU.KEY)).select(*RU.KEY, F.col("billing_j3").alias("billing"))
    d = (
        dealt(bh, *who, "block_start").join(adj.hint("merge"), [*who, "block_start"], "left")
        .join(billing, RU.KEY, "left")
        .withColumn("block_quarter", S.quarter_start("block_start"))
        .join(p, RU.KEY, "left")
    )
    d = dealt(d, *who, "block_quarter").join(qh.hint("merge"), [*who, "block_quarter"], "left")
    ms = F.col("ms_norm")
    special = S.is_special_project("proj_norm")
    in_m = RU._in(ms, K.MONTHLY_BUDGETS)
    in_q = RU._in(ms, K.QUARTERLY_BUDGETS)
    mdict = RU._dict_hours(ms, K.MONTHLY_BUDGETS).cast("double")
    qdict = RU._dict_hours(ms, K.QUARTERLY_BUDGETS).cast("double")
    prorated = S.block_days("block_start", "block_end").cast("double") / S.days_in_month("block_start").cast("double") * mdict
    soll = (
        F.when(special & in_m, prorated)
        .when(special & in_q, qdict)
        .otherwise(F.coalesce(F.col("csv_soll"), F.lit(0)).cast("double"))
    )
    ist = (
        F.when(special & in_m, F.col("hours"))
        .when(special & in_q, F.coalesce(F.col("quarter_hours"), F.lit(0)))
        .otherwise(F.coalesce(F.col("csv_ist"), F.lit(0)))
    ).cast("double")
    d = d.withColumns({"soll": soll, "ist": ist, "is_special": special})
    pct = F.when(F.col("soll") > 0, F.col("ist") / F.col("soll") * 100.0).otherwise(F.lit(0.0))
    return d.select(
        *report, "staff_name", *blocks, *RU.KEY, "is_special", "hours",
        F.when(F.col("soll") > 0, F.round("soll", 2)).alias("soll"),
        F.when(F.col("ist") > 0, F.round("ist", 2)).alias("ist"),
        F.when(F.col("soll") > 0, F.round(pct, 2)).alias("pct"),
        (pct <= 100.0).alias("eligible"), "billing", "adj_h",
    )


FLEX_HOURS = ["total_hours", "bonus_base", "special_base", "adj_regular", "adj_special", "bonus_total", "special_total"]


def flex_block_totals(rows: DataFrame) -> DataFrame:
    """B20 per (employee, block): hours, bonus bases, and with the adjustments the
    bonus totals; regular and special apart (D13)."""
    zero = F.lit(0).cast(S.EXACT)
    el, sp = F.col("eligible"), F.col("is_special")
    return rows.groupBy(*BK.report_of(rows), "staff_name", "block_name", "block_start", "block_end").agg(
        F.sum("hours").cast(S.EXACT).alias("total_hours"),
        F.coalesce(F.sum(F.when(el & ~sp, F.col("hours"))), zero).cast(S.EXACT).alias("bonus_base"),
        F.coalesce(F.sum(F.when(el & sp, F.col("hours"))), zero).cast(S.EXACT).alias("special_base"),
        F.coalesce(F.sum(F.when(~sp, F.col("adj_h"))), zero).cast(S.EXACT).alias("adj_regular"),
        F.coalesce(F.sum(F.when(sp, F.col("adj_h"))), zero).cast(S.EXACT).alias("adj_special"),
    ).withColumns({
        "bonus_total": (F.col("bonus_base") + F.col("adj_regular")).cast(S.EXACT),
        "special_total": (F.col("special_base") + F.col("adj_special")).cast(S.EXACT),
    })


def flex_summary(block_totals: DataFrame) -> DataFrame:
    """C3 + C4: per block over employees, and the grand total (block_name null)."""
    sums = [F.sum(c).cast(S.EXACT).alias(c) for c in FLEX_HOURS if c in block_totals.columns]
    if not BK.report_of(block_totals):
        return block_totals.rollup("block_name").agg(*sums)
    return block_totals.groupingSets([[BK.REPORT, "block_name"], [BK.REPORT]], BK.REPORT, "block_name").agg(*sums)


def budget_of(lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Plan, records, parent map and account of a budget export, from one landed pass."""
    prepared = BU.prepare(lines)
    records, edges = BU.budget_scan(prepared=prepared)
    return BU.plan_from_prepared(prepared), records, BU.parent_map_from_edges(edges), budget_account(prepared)


def flexible_report(entries_f: DataFrame, lines: DataFrame, cfg: ReportConfig, adjustments: DataFrame,
                    positions: DataFrame) -> dict[str, DataFrame]:
    """The flexible report: rows with billing, position and adjustment, totals per
    employee and block, totals per block and over all, budget overview."""
    (plan, records, pmap, unread), daily = concurrently(lambda: budget_of(lines), lambda: BK.landed_day_hours(entries_f))
    rows = RU.landed_rows(flex_rows(daily, plan, cfg, adjustments, lambda keys: RU.landed_budget(RU.resolve_budget(keys, records, pmap))))
    totals = flex_block_totals(rows)
    if not cfg.include_bonus_calc:
        totals = totals.drop(*FLEX_HOURS[1:])
        rows = rows.drop("adj_h")
    rows = rows.join(positions.select("staff_name", "position"), "staff_name", "left").withColumn(
        "position", F.coalesce("position", F.lit(K.POSITIONS[0])))
    out: dict[str, DataFrame] = {"flex_rows": rows, "flex_block_totals": totals, "budget_account": unread}
    if cfg.include_summary_sheet:
        out["flex_summary"] = flex_summary(totals)
    if cfg.include_budget_overview:
        out["budget_overview"] = BU.budget_overview(records)
    return {name: S.rounded(d) for name, d in out.items()}


# ------------------------------------------------------------ dispatch

def per_file(entries: DataFrame) -> DataFrame:
    """Entries that make one report per time file (S5, D12) when they are given to
    ``generate``, ``quarterly_job`` or ``standard_report``: one plan and one scan, each table with a
    column ``report`` (the file)."""
    return entries.withColumn(BK.REPORT, F.col("source_file"))


def generate(cfg: ReportConfig, entries: DataFrame, lines: DataFrame, adjustments: DataFrame,
             positions: DataFrame, account: DataFrame | None = None) -> dict[str, DataFrame]:
    """Quarterly + by month + one quarter -> standard report over the
    filtered entries and all three months of the quarter; project / employee ->
    summaries; otherwise the flexible report.  Component flags apply everywhere
    (D21).  With ``account`` (of ``scan_time_xml``) it and the budget's account are
    tables of the report."""
    return _with_accounts(_generate(cfg, require_rows(entries), lines, adjustments, positions), account)


def _with_accounts(out: dict[str, DataFrame], account: DataFrame | None) -> dict[str, DataFrame]:
    """A report with the accounts of unreadable values, if they are asked for."""
    budget = out.pop("budget_account", None)
    if account is not None:
        out["booking_account"] = account
        if budget is not None:
            out["budget_account"] = budget
    return out


def _generate(cfg, entries, lines, adjustments, positions):
    e = filtered_entries(entries, cfg)
    if cfg.report_type == "project":
        return {"project_summary": S.rounded(BK.project_summary(e))}
    if cfg.report_type == "employee":
        return {"employee_summary": S.rounded(BK.employee_summary(e))}
    q_start, q_end = S.parse_quarter(f"{cfg.start_date.year}Q{(cfg.start_date.month - 1) // 3 + 1}"), \
        S.parse_quarter(f"{cfg.end_date.year}Q{(cfg.end_date.month - 1) // 3 + 1}")
    if cfg.report_type == "quarterly" and cfg.time_grouping == "month" and q_start == q_end:
        spark = entries.sparkSession
        months = spark.range(1).select(F.explode(BK.quarter_months(q_start)).alias("month"))
        if BK.report_of(entries):
            months = entries.select(BK.REPORT).distinct().withColumn("month", F.explode(BK.quarter_months(q_start)))
        out = standard_report(filtered_entries(entries, cfg, by_employee=False), lines, adjustments, positions, months,
                              cfg.include_budget_overview, cfg.employees)
        if not cfg.include_summary_sheet:
            out.pop("cover_months"), out.pop("cover_quarter")
        if not cfg.include_bonus_calc:
            out["month_totals"] = out["month_totals"].select("staff_name", "quarter", "month", "total_hours")
        return out
    return flexible_report(e, lines, cfg, adjustments, positions)


def quarterly_job(entries: DataFrame, lines: DataFrame, adjustments: DataFrame, positions: DataFrame,
                  requested: str | None = None, account: DataFrame | None = None) -> tuple[date, dict[str, DataFrame]]:
    """Entry 1 (standard job): the requested quarter, or the latest one (O2,
    D16); months = months present in that quarter (T5).  One tiny action picks
    the quarter.  With one report per file each has the latest quarter of its own
    file; the quarter given back is the latest of all."""
    entries, picked = require_rows(entries), None
    if requested:
        q = S.parse_quarter(requested)
        if BK.in_quarter(entries, q).isEmpty():
            raise ValueError(f"{requested}: no booking in this quarter")
    else:
        q = entries.agg(F.max("quarter").alias("quarter")).first()["quarter"]
        if q is None:
            raise ValueError("no booking has a date, so there is no latest quarter")
        if BK.report_of(entries):
            latest = entries.groupBy(BK.REPORT).agg(F.max("quarter").alias("quarter"))
            picked = entries.join(latest, [BK.REPORT, "quarter"])
    out = standard_report(BK.in_quarter(entries, q) if picked is None else picked, lines, adjustments, positions, None)
    return q, _with_accounts(out, account)
