"""The budget export: plan per milestone, the milestone hierarchy, and the
budget records (billing type, fees, rates) of top-level milestones.

Input: raw budget lines (file_path, row_no, projekte, flag, package, soll_txt,
ist_txt, budget_txt, sollhonorar_txt, billed_txt, cost_txt); file order is
``row_no``.  Order-dependent rules (fill-down, parent runs, the section
scan) are two-phase scans from ``ordered``; everything after them is joins and
aggregates keyed by (file, section).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S
from ..session import materialize as _materialize
from . import ordered

RESET = "\u0000"
NUMERIC_TEXT = {
    "soll": "soll_txt",
    "ist": "ist_txt",
    "budget": "budget_txt",
    "sollhonorar": "sollhonorar_txt",
    "billed": "billed_txt",
    "cost": "cost_txt",
}


def first_pass(lines: DataFrame, materialize: bool = True, levels: int | None = None) -> DataFrame:
    """W1 per line: filled project, project of the previous row, position in file,
    and what follows from a line alone."""
    raw_proj = F.when(S.strip_unicode(F.col("projekte")) != "", F.col("projekte"))
    d = lines.withColumn("projekte", raw_proj)
    if materialize:
        d = _materialize(d, "budget-lines")
    levels = ordered.depth(d) if levels is None else levels
    d = ordered.scan(
        d, levels=levels,
        fills={"proj_filled": F.col("projekte")},
        prior_fills={"proj_before": F.col("projekte")},
        sums={"pos": F.lit(1).cast("long")},
    ).withColumn("pos", F.col("pos") - 1)
    pkg = S.strip_unicode(F.coalesce(F.col("package"), F.lit("")))
    d = d.withColumns({
        "projekt": F.coalesce(S.strip_unicode(F.col("proj_filled")), F.lit("")),
        "prev_projekt": S.strip_unicode(F.col("proj_before")),
        "pkg": pkg,
        "ms": S.norm_milestone(pkg),
        "flag_x": F.upper(S.strip_unicode(F.coalesce(F.col("flag"), F.lit("")))) == "X",
        **{k: S.de_number(v) for k, v in NUMERIC_TEXT.items()},
    })
    return d.withColumns({
        "dash_empty": (F.col("pkg") == "") | (F.col("pkg") == "-"),
        "changed": F.col("prev_projekt").isNull() | (F.col("projekt") != F.col("prev_projekt")),
    }).withColumn("is_top", F.col("flag_x") & ~F.col("dash_empty"))


def prepare(lines: DataFrame, materialize: bool = True, lookahead: int | None = None) -> DataFrame:
    """W1-W3 per line, in two ordered passes:

    pass 1: ``first_pass``;
    pass 2: position of the owning top-level row (W3) and the current parent of
    the run (W2: reset on project change and on dash/empty rows; a top-level row
    is its own parent).  A section ends at the next top-level row; ``lookahead``
    (an option, off by default) ends it after that many rows.

    Input and result are written to the session's checkpoint folder (reliable
    storage, so a lost executor does not re-run the scans) because the passes
    and every budget output read them several times.
    """
    levels = ordered.depth(lines)
    d = first_pass(lines, materialize, levels)
    marker = (
        F.when(~F.col("dash_empty") & (F.col("ms") != "") & F.col("flag_x"), F.col("ms"))
        .when(F.col("changed") | F.col("dash_empty"), F.lit(RESET))
    )
    d = ordered.scan(d, fills={"x_pos": F.when(F.col("is_top"), F.col("pos")), "parent_run": marker}, levels=levels)
    in_section = ~F.col("is_top") & ~F.col("dash_empty") & F.col("x_pos").isNotNull()
    if lookahead is not None:
        in_section &= (F.col("pos") - F.col("x_pos")) <= lookahead
    d = d.withColumns({
        "parent_run": F.when(F.col("parent_run") != RESET, F.col("parent_run")),
        "in_section": in_section,
    })
    if materialize:
        d = _materialize(d, "budget-prepared")
    return d


def plan_from_prepared(prepared: DataFrame) -> DataFrame:
    """A1 from already prepared lines (shares their scans with the records)."""
    d = prepared.where(F.col("package").isNotNull() & ~F.col("dash_empty") & F.col("proj_filled").isNotNull())
    g = d.groupBy(F.col("projekt").alias("proj_norm"), F.col("ms").alias("ms_norm")).agg(
        F.coalesce(F.sum("soll"), F.lit(0)).cast(S.EXACT).alias("soll"),
        F.coalesce(F.sum("ist"), F.lit(0)).cast(S.EXACT).alias("ist"),
    )
    return g.withColumn("pct", F.round(S.plan_pct("ist", "soll"), 2))


def plan_actual(lines: DataFrame, materialize: bool = True) -> DataFrame:
    """A1 (D7): target / actual hours per (project, milestone), keyed by the
    stripped names; P2 keeps package rows only.  Needs only the fill-down; the
    lines are landed first because the scan reads them twice."""
    raw_proj = F.when(S.strip_unicode(F.col("projekte")) != "", F.col("projekte"))
    d = lines.withColumn("projekte", raw_proj)
    if materialize:
        d = _materialize(d, "budget-lines")
    d = ordered.scan(d, fills={"proj_filled": F.col("projekte")})
    pkg = S.strip_unicode(F.coalesce(F.col("package"), F.lit("")))
    d = d.where(F.col("package").isNotNull() & (pkg != "-") & (pkg != "") & F.col("proj_filled").isNotNull())
    g = d.groupBy(S.strip_unicode(F.col("proj_filled")).alias("proj_norm"), S.norm_milestone(pkg).alias("ms_norm")).agg(
        F.coalesce(F.sum(S.de_number("soll_txt")), F.lit(0)).cast(S.EXACT).alias("soll"),
        F.coalesce(F.sum(S.de_number("ist_txt")), F.lit(0)).cast(S.EXACT).alias("ist"),
    )
    return g.withColumn("pct", F.round(S.plan_pct("ist", "soll"), 2))


def _marker(markers: list[str]):
    cond = None
    for m in markers:
        c = F.col("pkg").contains(m)
        cond = c if cond is None else (cond | c)
    return cond


def _kept_records(d: DataFrame) -> DataFrame:
    """W3-W8 over prepared lines: the records that count, with ``emit_ord``."""
    top = d.where("is_top").select(
        "file_path", "x_pos", "row_no",
        F.col("projekt").alias("project"),
        S.project_code("projekt").alias("project_code"),
        F.col("pkg").alias("top_milestone"),
        F.col("ms").alias("top_norm"),
        S.billing_type(F.col("package"), F.col("flag")).alias("billing"),
        F.col("sollhonorar").alias("total_budget"),
        F.col("billed"), F.col("cost"),
        F.col("soll").alias("own_soll"), F.col("ist").alias("actual_hours"),
    )
    sub = d.where("in_section")
    is_sv = _marker(K.POSITION_MARKERS["SV"])
    is_cad = ~is_sv & _marker(K.POSITION_MARKERS["CAD"])
    is_adm = ~is_sv & ~_marker(K.POSITION_MARKERS["CAD"]) & _marker(K.POSITION_MARKERS["ADM"])
    rate = F.col("budget").cast("double") / F.col("soll").cast("double")
    has_h = F.col("soll") > 0

    def last_rate(cond):  # W5: the last matching sub-row with hours wins
        return F.max_by(F.when(cond & has_h, rate), F.when(cond & has_h, F.col("pos")))

    sec = sub.groupBy("file_path", "x_pos").agg(
        F.sum(F.when(F.col("soll") > 0, F.col("soll"))).alias("sub_soll"),
        F.max("pos").alias("last_pos"),
        last_rate(is_sv).alias("rate_sv"),
        last_rate(is_cad).alias("rate_cad"),
        last_rate(is_adm).alias("rate_adm"),
    )
    flat = (F.col("billing") == K.BILLING_FLAT) & (F.col("own_soll") > 0)
    default_rate = F.when(flat, F.col("total_budget").cast("double") / F.col("own_soll").cast("double"))
    main = top.join(sec, ["file_path", "x_pos"], "left").select(
        "file_path", F.lit(1).alias("kind"),
        # after every row of its section, before the next top-level row
        (F.coalesce("last_pos", "x_pos") * 2 + 1).alias("emit_ord"),
        "project", "project_code", "top_milestone", "top_norm", "billing", "total_budget", "billed", "cost",
        F.when(F.col("sub_soll") > 0, F.col("sub_soll")).otherwise(F.col("own_soll")).cast(S.EXACT).alias("target_hours"),
        "actual_hours",
        *[F.coalesce(F.col(r), default_rate).alias(r) for r in ("rate_sv", "rate_cad", "rate_adm")],
    )

    # Supplement (Nachtrag) packages with their own fee become records too.
    fee = F.coalesce(F.when(F.col("budget") != 0, F.col("budget")), F.when(F.col("sollhonorar") != 0, F.col("sollhonorar")))
    own_billing = S.billing_type(F.col("package"), F.lit("X"), force=True)
    supp = (
        sub.where(S.is_supplement_package("pkg") & fee.isNotNull())
        .select("file_path", "x_pos", "pos", F.col("pkg").alias("top_milestone"), F.col("ms").alias("top_norm"),
                own_billing.alias("own_billing"), fee.alias("total_budget"), "billed", "cost",
                F.col("soll").alias("target_hours"), F.col("ist").alias("actual_hours"))
        .join(top.select("file_path", "x_pos", "project", "project_code", F.col("billing").alias("parent_billing")),
              ["file_path", "x_pos"])
    )
    sub_rate = F.when(F.col("target_hours") > 0, F.col("total_budget").cast("double") / F.col("target_hours").cast("double"))
    supp = supp.select(
        "file_path", F.lit(0).alias("kind"), (F.col("pos") * 2).alias("emit_ord"),
        "project", "project_code", "top_milestone", "top_norm",
        F.when(F.col("own_billing") == K.BILLING_UNKNOWN, F.col("parent_billing")).otherwise(F.col("own_billing")).alias("billing"),
        "total_budget", "billed", "cost", F.col("target_hours").cast(S.EXACT).alias("target_hours"), "actual_hours",
        sub_rate.alias("rate_sv"), sub_rate.alias("rate_cad"), sub_rate.alias("rate_adm"),
    )

    # First record per (project, milestone) in emit order wins; a section
    # emits its supplements before its own record.
    cand = main.unionByName(supp)
    w = Window.partitionBy("file_path", "project", "top_norm").orderBy("emit_ord")
    return cand.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def parent_edges(prepared: DataFrame, supplements: DataFrame) -> DataFrame:
    """W2 (+ W6 self-parents): one row (file_path, projekt, ms_norm, parent) per edge;
    ``supplements`` are records of kind 0."""
    runs = prepared.where(~F.col("dash_empty") & (F.col("ms") != "") & F.col("parent_run").isNotNull()).select(
        "file_path", "projekt", F.col("ms").alias("ms_norm"), F.col("parent_run").alias("parent"))
    return runs.unionByName(supplements.select(
        "file_path", F.col("project").alias("projekt"), F.col("top_norm").alias("ms_norm"), F.col("top_norm").alias("parent")))


def budget_scan(lines: DataFrame | None = None, prepared: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(budget_records, parent_entries).

    budget_records: file_path, project, project_code, top_milestone, top_norm,
    billing, total_budget, billed, cost, target_hours, actual_hours, rate_sv,
    rate_cad, rate_adm, lookup_key, lookup_id.
    parent_entries: file_path, projekt, ms_norm, parent (one row per edge).
    """
    d = prepared if prepared is not None else prepare(lines)
    kept = _kept_records(d)
    # Lookup ids 1..n in emit order, file after file
    last = d.agg(F.max("pos")).first()[0] or 0
    kept = ordered.running_sum(kept, F.lit(1).cast("long"), "lookup_id", order="emit_ord", levels=ordered.depth_of(2 * last + 1))
    kept = _materialize(kept, "budget-kept")
    counts = kept.groupBy("file_path").count()
    upto = ordered.running_total(counts, "file_path", F.col("count"), "upto").join(counts, "file_path")
    kept = kept.join(upto, "file_path").withColumn("lookup_id", F.col("lookup_id") + F.col("upto") - F.col("count"))
    records = kept.select(
        "file_path", "project", "project_code", "top_milestone", "top_norm", "billing",
        *[F.col(c).cast(S.EXACT).alias(c) for c in ("total_budget", "billed", "cost", "target_hours", "actual_hours")],
        "rate_sv", "rate_cad", "rate_adm",
        F.concat_ws("||", "project", "top_norm").alias("lookup_key"),
        F.col("lookup_id").cast("int").alias("lookup_id"),
        "kind",
    )
    # records are one row per top-level milestone and read by several joins of
    # the resolution; land them once
    records = _materialize(records, "budget-records")
    return records.drop("kind"), parent_edges(d, records.where(F.col("kind") == 0))


def budget_records(lines: DataFrame) -> DataFrame:
    return budget_scan(lines)[0]


def budget_records_of(prepared: DataFrame) -> DataFrame:
    return budget_scan(prepared=prepared)[0]


def parent_map(lines: DataFrame) -> DataFrame:
    """W2 (+ W6 self-parents): (project_key, ms_norm) -> sorted distinct parents,
    emitted for the full name and for the project code."""
    d = prepare(lines)
    return parent_map_from_edges(parent_edges(d, _kept_records(d).where(F.col("kind") == 0)))


def parent_map_from_edges(edges: DataFrame) -> DataFrame:
    keyed = edges.select(F.explode(S.project_keys("projekt")).alias("project_key"), "ms_norm", "parent")
    return keyed.groupBy("project_key", "ms_norm").agg(
        F.array_sort(F.collect_set("parent")).alias("parents")
    ).withColumn("n_parents", F.size("parents"))


def budget_overview(records: DataFrame) -> DataFrame:
    """Completeness status, remarks and available budget per record."""
    has_billing = F.col("billing") != K.BILLING_UNKNOWN
    has_rates = (
        F.coalesce(F.col("rate_sv") > 0, F.lit(False))
        | F.coalesce(F.col("rate_cad") > 0, F.lit(False))
        | F.coalesce(F.col("rate_adm") > 0, F.lit(False))
    )
    return records.select(
        "project", "top_milestone", "billing",
        F.when(F.col("target_hours") > 0, F.col("target_hours")).alias("target_hours"),
        F.when(has_billing & has_rates, F.lit(K.STATUS_COMPLETE)).otherwise(F.lit(K.STATUS_MANUAL)).alias("status"),
        F.when(F.col("total_budget") > 0, F.col("total_budget")).alias("total_budget"),
        F.when(F.col("billed") > 0, F.col("billed")).otherwise(F.lit(0).cast(S.EXACT)).alias("billed"),
        (F.coalesce(F.col("total_budget"), F.lit(0)) - F.coalesce(F.col("billed"), F.lit(0))).cast(S.EXACT).alias("available"),
        F.round("rate_sv", 4).alias("rate_sv"), F.round("rate_cad", 4).alias("rate_cad"), F.round("rate_adm", 4).alias("rate_adm"),
        F.concat_ws("; ", F.when(~has_billing, F.lit(K.REMARK_BILLING)), F.when(~has_rates, F.lit(K.REMARK_RATES))).alias("remark"),
        "lookup_id",
    )
