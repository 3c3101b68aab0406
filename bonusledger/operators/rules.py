"""Business rules: target / actual per employee-month row, bonus eligibility,
adjustments and transfers between employees, budget resolution and revenue.

Shapes:
  month rows   one row per (staff, month, project key, milestone key) of the quarter
  month totals one row per (staff, month)
Totals over a group that may be hot (every employee books the shared special
project) are hash aggregates joined back, never a window over the hot group; with
``hot`` (``hot_keys`` of the landed month hours) those joins spread the rows of hot
keys (J1, J8, A14, W11).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from . import bookings as BK
from . import heavy

KEY = ["proj_norm", "ms_norm"]
MONEY = "double"


def _in(col: Column, names) -> Column:
    return col.isin(list(names))


def _dict_hours(col: Column, table: dict) -> Column:
    expr = None
    for name, h in table.items():
        expr = (F.when if expr is None else expr.when)(col == name, F.lit(h).cast(S.EXACT))
    return expr


def hot_keys(mh: DataFrame) -> heavy.HotKeys:
    """The keys that hold much of the (landed) month hours."""
    return heavy.hot_keys(mh, KEY)


def month_rows(mh: DataFrame, plan: DataFrame, hot: heavy.HotKeys | None = None) -> DataFrame:
    """Decision table of SURVEY 7.1 (B1-B5 with J1, J7, W10, W11, W13).

    mh: month hours (A2) of the report quarter, all employees (W11 must see
    everyone, D20); the report lands it once and derives everything from it.
    plan: plan_actual (proj_norm, ms_norm, soll, ist).
    """
    fut = BK.future_hours_all_staff(mh)
    mh = BK.cumulative_quarter_hours(mh)
    p = plan.select(*KEY, F.col("soll").alias("csv_soll"), F.col("ist").alias("csv_ist"))
    # plan and future hours meet per key and month first, so the employees' rows are joined once
    by_key, report = fut.join(p, KEY, "left"), BK.report_of(mh)
    d = heavy.join(mh, by_key, [*report, *KEY, "quarter", "month"], hot, ["staff_name"])

    ms = F.col("ms_norm")
    zero = F.lit(0).cast(S.EXACT)
    csv_soll = F.coalesce(F.col("csv_soll"), zero)
    csv_ist = F.coalesce(F.col("csv_ist"), zero)
    monthly = S.milestone_type(ms) == "monthly"
    special = S.is_special_project("proj_norm")
    in_mdict = _in(ms, K.MONTHLY_BUDGETS)
    in_qdict = _in(ms, K.QUARTERLY_BUDGETS)
    nb_h, nb_unit = S.name_budget_hours(ms), S.name_budget_unit(ms)
    mdict_h, qdict_h = _dict_hours(ms, K.MONTHLY_BUDGETS), _dict_hours(ms, K.QUARTERLY_BUDGETS)

    # B1: dictionary override (pass 1: no plan values; pass 2: special project)
    b1 = monthly & in_mdict & (((csv_soll == 0) & (csv_ist == 0)) | special)
    soll1 = F.when(b1, mdict_h).otherwise(csv_soll)
    ist1 = F.when(b1, F.col("hours")).otherwise(csv_ist)

    # B2 / B3 (+ W13 roll-back with the future hours of all employees)
    m_soll = (
        F.when(special & in_mdict, mdict_h)
        .when(special & (nb_unit == "monat") & nb_h.isNotNull(), nb_h)
        .otherwise(soll1)
    )
    m_ist = F.when(special, F.col("hours")).otherwise(ist1 - F.coalesce(F.col("future_hours"), zero))
    # Quarterly target
    q_soll = (
        F.when((nb_unit == "quartal") & nb_h.isNotNull(), nb_h)
        .when(in_qdict, qdict_h)
        .when(soll1 > 0, soll1)
        .otherwise(zero)
    )
    soll = F.when(monthly, m_soll).otherwise(q_soll).cast(S.EXACT)
    ist = F.when(monthly, m_ist).otherwise(F.col("cum_hours")).cast(S.EXACT)
    d = d.withColumns({
        "milestone_type": S.milestone_type(ms),
        "is_special": special,
        "soll": soll,
        "ist": ist,
    })
    pct = S.pct("ist", "soll")
    d = d.withColumns({
        "pct": pct,
        # All hours or none; no target means eligible
        "eligible": F.when(F.col("soll") > 0, pct <= 100.0).otherwise(F.lit(True)),
        "status": F.when(F.col("soll") > 0, S.status_band(pct)),
    })
    quarterly = F.col("milestone_type") == "quarterly"
    return d.select(
        *report, "staff_name", "quarter", "month", *KEY, "milestone_type", "is_special", "hours",
        # quarterly rows show '-' (null) for target and % when there is no target
        F.when(quarterly & (F.col("soll") == 0), F.lit(None).cast(S.EXACT)).otherwise(F.col("soll")).alias("soll"),
        "ist",
        F.when(quarterly & (F.col("soll") == 0), F.lit(None).cast("double")).otherwise(F.round("pct", 2)).alias("pct"),
        "eligible", "status",
        F.col("soll").alias("target_for_revenue"),
    )


def with_adjustments(rows: DataFrame, adjustments: DataFrame) -> DataFrame:
    """B6/B7 inputs and J9: joins the user adjustments (H, J) to the month rows,
    derives the transferable hours I and the hours K assigned by others.

    J9 is one hash aggregate of donors by (key, month, recipient) and one join;
    donors assigning to themselves do not count, and hours sent to someone
    without a row on that key and month are not received.
    """
    report, who = BK.report_of(rows), [*BK.report_of(rows, adjustments), "staff_name", *KEY, "month"]
    adj = adjustments.groupBy(*who).agg(
        F.sum("adj_h").cast(S.EXACT).alias("adj_h"), F.max("assign_to").alias("assign_to")
    )
    d = rows.join(adj, who, "left")
    transferable = F.when(
        F.col("adj_h") < 0, F.greatest(F.lit(0).cast(S.EXACT), F.least(F.col("hours"), -F.col("adj_h")))
    ).otherwise(F.lit(0).cast(S.EXACT))
    d = d.withColumn("transferable", transferable.cast(S.EXACT))
    received = (
        d.where(F.col("assign_to").isNotNull() & (F.col("assign_to") != F.col("staff_name")))
        .groupBy(*report, *KEY, "month", F.col("assign_to").alias("staff_name"))
        .agg(F.sum("transferable").cast(S.EXACT).alias("from_others"))
    )
    d = d.join(received, [*report, "staff_name", *KEY, "month"], "left")
    return d.withColumn("from_others", F.coalesce(F.col("from_others"), F.lit(0).cast(S.EXACT)))


def landed_rows(rows_adj: DataFrame) -> DataFrame:
    """The report's row table (month rows with adjustments and transfers, the
    K1 sheet) landed once: revenue, totals, quarter summary and the per-key
    revenue all read it, and each reads it more than once."""
    from ..session import materialize

    return materialize(rows_adj, "month-rows")


def coworkers(rows: DataFrame, hot: heavy.HotKeys | None = None) -> DataFrame:
    """J8 / A9 without pairs: the distinct employees per (key, month) as rows, and
    per month row the number of other employees it could assign hours to."""
    report = BK.report_of(rows)
    n = rows.groupBy(*report, *KEY, "month").agg(F.countDistinct("staff_name").alias("n_staff"))
    rows = rows.select(*report, "staff_name", *KEY, "month")
    return heavy.join(rows, n, [*report, *KEY, "month"], hot, ["staff_name"], "inner").withColumn("n_others", F.col("n_staff") - 1)


def month_totals(rows_adj: DataFrame) -> DataFrame:
    """Per (staff, month) hours, bonus bases, adjustments and
    totals (regular and special kept apart, D13)."""
    elig = F.col("eligible")
    sp = F.col("is_special")
    zero = F.lit(0).cast(S.EXACT)

    def hsum(c):
        return F.coalesce(F.sum(c), zero).cast(S.EXACT)

    g = rows_adj.groupBy(*BK.report_of(rows_adj), "staff_name", "quarter", "month").agg(
        hsum("hours").alias("total_hours"),
        hsum(F.when(elig & ~sp, F.col("hours"))).alias("bonus_base"),
        hsum(F.when(elig & sp, F.col("hours"))).alias("special_base"),
        hsum(F.when(~sp, F.col("adj_h"))).alias("adj_regular"),
        hsum(F.when(sp, F.col("adj_h"))).alias("adj_special"),
        hsum("from_others").alias("assigned"),
    )
    g = g.withColumns({
        "bonus_total": (F.col("bonus_base") + F.col("adj_regular")).cast(S.EXACT),
        "special_total": (F.col("special_base") + F.col("adj_special")).cast(S.EXACT),
    })
    return g.withColumn(
        "total_bonus", (F.col("bonus_total") + F.col("special_total") + F.col("assigned")).cast(S.EXACT)
    )


# ------------------------------------------------------------ budget resolution

_REC_FIELDS = ["lookup_id", "billing", "target_hours", "cost", "rate_sv", "rate_cad", "rate_adm", "total_budget"]


def _lookup_table(records: DataFrame) -> DataFrame:
    """(key, milestone) -> record, one row per key pair of the budget:
    ``rec``  over the full name and the code (J3; a later record wins),
    ``lrec`` over the last key only (the id map of J4 keeps the code when it
    differs from the full name, D6; a later record wins)."""
    r = records.where(~F.col("project").isin("", "-", "nan") & (F.col("top_norm") != ""))
    keys = S.project_keys("project")
    ex = r.select(
        F.posexplode(keys).alias("kpos", "key"), F.size(keys).alias("n_keys"),
        F.col("top_norm").alias("cand_ms"), F.struct(*_REC_FIELDS).alias("r"), "lookup_id",
    )
    is_last = F.col("kpos") == F.col("n_keys") - 1
    return ex.groupBy("key", "cand_ms").agg(
        F.max_by("r", "lookup_id").alias("rec"),
        F.max_by("r", F.when(is_last, F.col("lookup_id"))).alias("lrec"),
    )


def resolve_budget(keys: DataFrame, records: DataFrame, pmap: DataFrame) -> DataFrame:
    """J3 + J4 for the distinct (proj_norm, ms_norm) keys of a report.

    Candidates per key, in the reference's order over [full name, code]:
      J3       exact milestone (2*kpos), its single parent (2*kpos+1); first hit
      primary  exact milestone on the id map (kpos); first hit
      fallback alphabetically first parent of the first key that has parents,
               on the id map (kpos); used only without a primary
    One join of all candidates with the lookup table and one aggregate pick the
    winners; the records' fields ride along, so no join back to the records.

    Output: proj_norm, ms_norm, res_id, lookup_id, billing, rate_sv, rate_cad,
    rate_adm, budget_total, target_hours_q (B11 Q), cost_s (B11 S).
    """
    k = keys.select(*KEY).distinct()
    kk = k.select(*KEY, F.posexplode(S.project_keys("proj_norm")).alias("kpos", "key"))
    pm = pmap.select(F.col("project_key").alias("key"), "ms_norm", "parents", "n_parents")
    kk = kk.join(pm, ["key", "ms_norm"], "left")
    w = Window.partitionBy(*KEY).orderBy("kpos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kk = kk.withColumn(
        "fb_parent", F.first(F.when(F.col("n_parents") >= 1, F.element_at("parents", 1)), ignorenulls=True).over(w)
    )
    exact = kk.select(*KEY, "key", "kpos", F.col("ms_norm").alias("cand_ms"), F.lit("exact").alias("kind"))
    parent = kk.where(F.col("n_parents") == 1).select(
        *KEY, "key", "kpos", F.element_at("parents", 1).alias("cand_ms"), F.lit("parent").alias("kind"))
    fallback = kk.where(F.col("fb_parent").isNotNull()).select(
        *KEY, "key", "kpos", F.col("fb_parent").alias("cand_ms"), F.lit("fallback").alias("kind"))
    cands = exact.unionByName(parent).unionByName(fallback).join(_lookup_table(records), ["key", "cand_ms"])
    kind = F.col("kind")
    j3_prio = F.when(kind == "exact", F.col("kpos") * 2).when(kind == "parent", F.col("kpos") * 2 + 1)
    picked = cands.groupBy(*KEY).agg(
        F.min_by("rec", j3_prio).alias("j3"),
        F.min_by("lrec", F.when((kind == "exact") & F.col("lrec").isNotNull(), F.col("kpos"))).alias("prim"),
        F.min_by("lrec", F.when((kind == "fallback") & F.col("lrec").isNotNull(), F.col("kpos"))).alias("fb"),
    )
    out = k.join(picked, KEY, "left").withColumn("lk", F.coalesce("prim", "fb"))
    q_target = F.coalesce(F.col("j3"), F.col("prim"), F.col("fb"))["target_hours"]
    return out.select(
        *KEY,
        F.col("j3.lookup_id").alias("res_id"),
        F.col("lk.lookup_id").alias("lookup_id"),
        F.coalesce(F.col("j3.billing"), F.lit(K.BILLING_UNKNOWN)).alias("billing_j3"),
        F.when(F.col("lk").isNotNull(), F.coalesce(F.col("lk.billing"), F.lit(""))).otherwise(
            F.lit(K.BILLING_UNKNOWN)).alias("billing"),
        F.col("lk.rate_sv").alias("rate_sv"), F.col("lk.rate_cad").alias("rate_cad"),
        F.col("lk.rate_adm").alias("rate_adm"),
        F.coalesce(F.col("lk.total_budget"), F.lit(0).cast(S.EXACT)).alias("budget_total"),
        F.when(q_target != 0, q_target).alias("target_hours_q"),
        F.when(F.col("j3.cost") != 0, F.col("j3.cost")).alias("cost_s"),
    )


def _with_revenue(d: DataFrame, target: str, actual: str, hours: str, received: str) -> DataFrame:
    """B9 / B10 on rows carrying billing, rates, budget_total and position:
    rate by position (J6), revenue (Pauschale capped at the rest of the budget),
    possible revenue (no cap) and lost revenue.  Money is double."""
    d = d.withColumn("position", F.coalesce(F.col("position"), F.lit("SV")))
    dash = F.col("position") == "-"
    rate = (
        F.when(dash, F.lit(0.0))
        .when(F.col("lookup_id").isNull(), F.lit(0.0))
        .when(F.col("position") == "CAD", F.coalesce(F.col("rate_cad"), F.lit(0.0)))
        .when(F.col("position") == "ADM", F.coalesce(F.col("rate_adm"), F.lit(0.0)))
        .otherwise(F.coalesce(F.col("rate_sv"), F.lit(0.0)))
    )
    R = F.coalesce(F.col("budget_total"), F.lit(0)).cast(MONEY)
    D = F.coalesce(F.col(target), F.lit(0)).cast(MONEY)
    E = F.coalesce(F.col(actual), F.lit(0)).cast(MONEY)
    FK = (F.col(hours) + F.col(received)).cast(MONEY)
    flat = F.col("billing") == K.BILLING_FLAT
    no_base = (R == 0) | (D == 0)
    revenue = (
        F.when(dash, F.lit(0.0))
        .when(flat, F.when(no_base, F.lit(0.0)).otherwise(
            F.greatest(F.lit(0.0), F.least(R * (FK / D), R - R * (E / D)))))
        .otherwise(F.col("rate") * FK)
    )
    possible = (
        F.when(dash, F.lit(0.0))
        .when(flat, F.when(no_base, F.lit(0.0)).otherwise(R * (FK / D)))
        .otherwise(F.col("rate") * FK)
    )
    d = d.withColumn("rate", rate).withColumns({"revenue": revenue, "possible": possible})
    return d.withColumn("lost", F.col("possible") - F.col("revenue"))


def landed_budget(resolved: DataFrame) -> DataFrame:
    """The resolution of a report's keys (one row per key), landed: month and
    quarter revenue both join it, and its exact size decides how."""
    from ..session import materialize

    return materialize(resolved, "budget-resolved")


def revenue_totals(rows: DataFrame, *by: str) -> DataFrame:
    """Revenue, possible, lost and cumulative revenue per employee and quarter,
    or finer by the columns given."""
    return rows.groupBy(*BK.report_of(rows), "staff_name", "quarter", *by).agg(
        *[F.sum(c).alias(c) for c in ("revenue", "possible", "lost", "revenue_key")])


def revenue_rows(rows_adj: DataFrame, resolved: DataFrame, positions: DataFrame,
                 hot: heavy.HotKeys | None = None) -> DataFrame:
    """J5, J6, B9-B11, A14 per month row."""
    pos = positions.select("staff_name", "position")
    d = heavy.join(rows_adj, resolved, KEY, hot, ["staff_name", "month"]).join(pos, "staff_name", "left")
    d = _with_revenue(d, "target_for_revenue", "ist", "hours", "from_others")
    # Revenue of all employees on the key and month (aggregate + join: the
    # shared key is hot, a window over it would be one task)
    on = [*BK.report_of(d), *KEY, "month"]
    by_key = d.groupBy(*on).agg(F.sum("revenue").alias("revenue_key"))
    return heavy.join(d, by_key, on, hot, ["staff_name"])


def quarter_revenue(qsummary: DataFrame, resolved: DataFrame, positions: DataFrame,
                    hot: heavy.HotKeys | None = None) -> DataFrame:
    """J5 / B9 / B10 / A14 on the quarter summary rows: target = quarter target
    ('-' counts 0), actual = quarter actual, hours = the row's F (months' F+I+K),
    received = the months' K; revenue of all employees per key."""
    pos = positions.select("staff_name", "position")
    d = heavy.join(qsummary, resolved, KEY, hot, ["staff_name"]).join(pos, "staff_name", "left")
    d = _with_revenue(d, "q_soll", "q_ist", "q_hours", "from_others")
    on = [*BK.report_of(d), *KEY, "quarter"]
    by_key = d.groupBy(*on).agg(F.sum("revenue").alias("revenue_key"))
    return heavy.join(d, by_key, on, hot, ["staff_name"])


# ------------------------------------------------------------------ quarter

def quarter_milestones(mh: DataFrame, plan: DataFrame, hot: heavy.HotKeys | None = None) -> DataFrame:
    """Quarterly-type milestones of each employee: Q target (as B4), Q hours."""
    q = BK.quarter_hours(mh)
    p = plan.select(*KEY, F.col("soll").alias("csv_soll"))
    q = q.where(S.milestone_type("ms_norm") == "quarterly")
    d = heavy.join(q, p, KEY, hot, ["staff_name"])
    ms = F.col("ms_norm")
    nb_h, nb_unit = S.name_budget_hours(ms), S.name_budget_unit(ms)
    zero = F.lit(0).cast(S.EXACT)
    q_soll = (
        F.when((nb_unit == "quartal") & nb_h.isNotNull(), nb_h)
        .when(_in(ms, K.QUARTERLY_BUDGETS), _dict_hours(ms, K.QUARTERLY_BUDGETS))
        .when(F.coalesce(F.col("csv_soll"), zero) > 0, F.col("csv_soll"))
        .otherwise(zero)
    ).cast(S.EXACT)
    d = d.withColumn("q_soll", q_soll)
    pct = S.pct("hours", "q_soll")
    return d.select(
        *BK.report_of(d), "staff_name", "quarter", *KEY,
        F.when(F.col("q_soll") > 0, F.col("q_soll")).alias("q_soll"),
        F.col("hours").alias("q_ist"),
        F.when(F.col("q_soll") > 0, F.round(pct, 2)).alias("pct"),
        F.when(F.col("q_soll") > 0, S.status_band(pct)).alias("status"),
    )


def quarter_summary(rows_adj: DataFrame, plan: DataFrame, hot: heavy.HotKeys | None = None) -> DataFrame:
    """B15 + B16 per (staff, key) of the quarter; bookings without a plan row are
    absent (D5)."""
    g = rows_adj.groupBy(*BK.report_of(rows_adj), "staff_name", "quarter", *KEY).agg(
        F.sum("hours").cast(S.EXACT).alias("q_hours"),
        F.sum(F.col("hours") + F.col("transferable") + F.col("from_others")).cast(S.EXACT).alias("q_total"),
        F.sum(F.coalesce(F.col("adj_h"), F.lit(0))).cast(S.EXACT).alias("q_adj"),
        F.sum("from_others").cast(S.EXACT).alias("q_from_others"),
    )
    p = plan.select(*KEY, F.col("soll").alias("csv_soll"), F.col("ist").alias("csv_ist"))
    d = heavy.join(g, p, KEY, hot, ["staff_name"], "inner")
    ms = F.col("ms_norm")
    nb_h, nb_unit = S.name_budget_hours(ms), S.name_budget_unit(ms)
    zero = F.lit(0).cast(S.EXACT)
    special = S.is_special_project("proj_norm")
    sp_soll = (
        F.when((nb_unit == "quartal") & nb_h.isNotNull(), nb_h)
        .when((nb_unit == "monat") & nb_h.isNotNull(), nb_h * 3)
        .when(_in(ms, K.QUARTERLY_BUDGETS), _dict_hours(ms, K.QUARTERLY_BUDGETS))
        .when(_in(ms, K.MONTHLY_BUDGETS), _dict_hours(ms, K.MONTHLY_BUDGETS) * 3)
        .otherwise(zero)
    )
    q_soll = F.when(special, sp_soll).otherwise(F.coalesce(F.col("csv_soll"), zero)).cast(S.EXACT)
    q_ist = F.when(special, F.col("q_hours")).otherwise(F.coalesce(F.col("csv_ist"), zero)).cast(S.EXACT)
    d = d.withColumns({"q_soll": q_soll, "q_ist": q_ist})
    pct = S.pct("q_ist", "q_soll")
    transferable = F.when(
        F.col("q_adj") < 0, F.greatest(zero, F.least(F.col("q_total"), -F.col("q_adj")))
    ).otherwise(zero)
    return d.select(
        *BK.report_of(d), "staff_name", "quarter", *KEY, special.alias("is_special"),
        F.when(F.col("q_soll") > 0, F.col("q_soll")).alias("q_soll"),
        "q_ist",
        F.when(F.col("q_soll") > 0, F.round(pct, 2)).alias("pct"),
        F.col("q_total").alias("q_hours"),
        F.col("q_adj").alias("adj_h"),
        transferable.cast(S.EXACT).alias("transferable"),
        F.col("q_from_others").alias("from_others"),
    )


def quarter_totals(totals: DataFrame) -> DataFrame:
    """B17 (D4): per employee over the months of the quarter; bonus without
    adjustments (``bonus_base``) and with them (``bonus_total``) side by side."""
    cols = ["total_hours", "bonus_base", "special_base", "bonus_total", "special_total", "assigned", "total_bonus"]
    return totals.groupBy(*BK.report_of(totals), "staff_name", "quarter").agg(
        *[F.sum(c).cast(S.EXACT).alias(c) for c in cols], F.count("*").alias("n_months")
    )
