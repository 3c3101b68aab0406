"""Bridge: the driver's TPC-H-like tables seen as the budget/bookings model.

* ``bookings``      time entries  = lineitem JOIN part JOIN supplier
* ``budget_lines``  one budget export (raw text columns, file order in row_no),
                    derived from the bookings so its size follows the data
* ``adjustments``   user-entered hour adjustments / assignments
* ``positions``     employee positions

All are lazy DataFrames over the parquet scans; nothing is collected.  The
mapping itself is documented in FIXTURES.md section 4.
"""

from __future__ import annotations

import weakref
from decimal import Decimal
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import scalars as S

REPORT_QUARTER = "1998Q3"
SPECIAL_MONTHLY = list(K.MONTHLY_BUDGETS)
SPECIAL_QUARTERLY = list(K.QUARTERLY_BUDGETS)
# Fixed values of the bridge: part types in budget-line order, and the milestone
# names used for regular projects (n > 2).
PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
REGULAR_MILESTONES = [
    "1.1 Economy",
    "1.2 Large (2,5h pro Monat)",
    "1.3 Medium",
    "1.4 Promo Quartal",
    "1.5 Small (6 h/Quartal)",
    "1.6 Standard",
]


_handles: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A read-only test table.  The DataFrame handle (file listing and footer
    schema, no data) is reused per session and path; every query still scans."""
    path = f"{sf_dir}/{name}.parquet"
    own = _handles.setdefault(spark, {})
    if path not in own:
        own[path] = spark.read.parquet(path)
    return own[path]


def project_name(n: Column) -> Column:
    return (
        F.when(n == 1, F.lit("0000 Intern"))
        .when(n == 2, F.lit("0000.02 Verwaltung"))
        .otherwise(F.concat((n + 1000).cast("string"), F.lit(".01 Projekt "), n.cast("string")))
    )


@lru_cache(maxsize=None)
def _name_maps() -> tuple[Column, Column]:
    """Part type -> milestone name, for the special and the regular projects
    (map literals built once per process)."""
    special = F.create_map(*[F.lit(x) for kv in zip(PART_TYPES, SPECIAL_MONTHLY + SPECIAL_QUARTERLY) for x in kv])
    regular = F.create_map(*[F.lit(x) for kv in zip(PART_TYPES, REGULAR_MILESTONES) for x in kv])
    return special, regular


def milestone_name(n: Column, ptype: Column) -> Column:
    """Milestone of a part: the shared budget names for the two special
    projects (n <= 2), the regular names otherwise; by part type."""
    special, regular = _name_maps()
    return F.when(n <= 2, F.element_at(special, ptype)).otherwise(F.element_at(regular, ptype))


def _brand_number(p_brand: Column) -> Column:
    return F.substring(p_brand, 7, 10).cast("int")


def bookings(spark: SparkSession, sf_dir: str, files: int = 0) -> DataFrame:
    """Time entries in the normalised schema of the XML scan, from so many ``files``.

    Project and milestone names depend on the part only, so they (and their
    normalised keys) are computed on the part table before the join instead of
    once per line item."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    source = F.concat(F.lit("times-"), (F.col("l_orderkey") % files).cast("string")) if files else F.lit("lineitem")
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    n = _brand_number(F.col("p_brand"))
    names = part.select(
        "p_partkey",
        project_name(n).alias("project"),
        milestone_name(n, F.col("p_type")).alias("work_package_name"),
    ).withColumns({
        "proj_norm": S.norm_project("project"),
        "ms_norm": S.norm_milestone("work_package_name"),
    })
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    df = li.join(names, li.l_partkey == names.p_partkey).join(supp, li.l_suppkey == supp.s_suppkey)
    booked_on = F.col("l_shipdate").cast("date")
    return df.select(
        F.col("s_name").alias("staff_name"),
        "project", "work_package_name",
        booked_on.alias("booked_on"),
        (F.col("l_quantity") * F.lit(0.25)).cast(S.HOURS).alias("hours"),
        source.alias("source_file"),
        S.month_start(booked_on).alias("month"),
        S.quarter_start(booked_on).alias("quarter"),
        "proj_norm", "ms_norm",
    )


def with_entry_keys(df: DataFrame) -> DataFrame:
    """Adds month, quarter, proj_norm, ms_norm to raw time entries."""
    return df.withColumns(
        {
            "month": S.month_start("booked_on"),
            "quarter": S.quarter_start("booked_on"),
            "proj_norm": S.norm_project("project"),
            "ms_norm": S.norm_milestone("work_package_name"),
        }
    )


def _de_text(x: Column) -> Column:
    """A decimal as German text (the export's format)."""
    return F.replace(x.cast("string"), F.lit("."), F.lit(","))


def budget_lines(spark: SparkSession, sf_dir: str, quarter: str = REPORT_QUARTER) -> DataFrame:
    """One budget export derived from the data (see FIXTURES.md section 4).

    Columns: file_path, row_no, projekte, flag, package, soll_txt, ist_txt,
    budget_txt, sollhonorar_txt, billed_txt, cost_txt (raw strings).  Every brand
    expands to its fixed line templates in one generator pass; only the six
    milestone lines take numbers from the bookings.
    """
    q_end = F.date_sub(F.add_months(F.lit(S.parse_quarter(quarter)), 3), 1)
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    brands = part.select(_brand_number(F.col("p_brand")).alias("n")).distinct()
    li = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_shipdate")
    booked = (
        li.where(F.col("l_shipdate").cast("date") <= q_end)
        .join(part, li.l_partkey == part.p_partkey)
        .groupBy(_brand_number(F.col("p_brand")).alias("n"), F.col("p_type").alias("ptype"))
        .agg(F.sum((F.col("l_quantity") * F.lit(0.25)).cast(S.HOURS)).cast(S.HOURS).alias("booked"))
    )
    null = F.lit(None).cast("string")
    n = F.col("n")

    def template(k, ptype=null, projekte=null, flag=null, package=null, soll=null, budget=null,
                 fee=null, cost=null):
        return F.struct(
            F.lit(k).alias("k"), ptype.alias("ptype"), projekte.alias("projekte"), flag.alias("flag"),
            package.alias("package"), soll.alias("fixed_soll"), budget.alias("budget_txt"),
            fee.alias("sollhonorar_txt"), cost.alias("cost_txt"),
        )

    top_pkg = (F.when(n % 3 == 0, F.lit("(p) 1 Paket")).when(n % 3 == 1, F.lit("(aN) 1 Paket"))
               .otherwise(F.lit("1 Paket")))
    templates = [
        template(0, projekte=project_name(n), package=F.lit("-")),
        template(1, flag=F.lit("X"), package=top_pkg,
                 fee=F.concat((n * 1000).cast("string"), F.lit(",00")),
                 cost=F.concat((n * 100).cast("string"), F.lit(",00"))),
        *[template(i + 2, ptype=F.lit(t), package=F.concat(F.lit("• "), milestone_name(n, F.lit(t))))
          for i, t in enumerate(PART_TYPES)],
        *[template(k, package=F.lit(p), soll=F.lit("10,00"), budget=F.lit(b))
          for k, p, b in [(8, "'   SV", "900,00"), (9, "'   CAD", "700,00"), (10, "'   ADM", "500,00")]],
        template(11, package=F.lit("NAT 01 Zusatz"), soll=F.lit("8,00"), budget=F.lit("400,00")),
        # long sections (n % 7 = 0) end with a rate and a supplement
        template(200, package=F.lit("'   SV"), soll=F.lit("4,00"), budget=F.lit("380,00")),
        template(201, package=F.lit("NAT 02 Zusatz"), soll=F.lit("2,00"), budget=F.lit("150,00")),
    ]
    lines = brands.select("n", F.inline(F.array(*templates))).where(
        ((F.col("k") != 11) | (n % 5 == 0)) & ((F.col("k") < 200) | (n % 7 == 0)))
    many = brands.where(n % 7 == 0).select("n", F.explode(F.sequence(F.lit(20), F.lit(199))).alias("k")).select(
        "n", "k", F.concat(F.lit("• 2."), F.col("k").cast("string"), F.lit(" Position")).alias("package"),
        F.lit("0,125").alias("fixed_soll"))
    lines = lines.unionByName(many, allowMissingColumns=True)
    lines = lines.join(booked, ["n", "ptype"], "left")
    is_ms = F.col("ptype").isNotNull() & (n != 2)
    factor = F.lit(Decimal("0.8")) + F.lit(Decimal("0.1")) * (n % 5)
    booked_h = F.coalesce(F.col("booked"), F.lit(0).cast(S.HOURS))
    return lines.select(
        F.lit("bridge/budget.csv").alias("file_path"),
        # numbers that put borders of the ordered scans' chunks inside sections
        (n * 65526 + F.col("k")).cast("long").alias("row_no"),
        "projekte", "flag", "package",
        F.when(is_ms, _de_text((booked_h * factor).cast(S.HOURS))).otherwise(F.col("fixed_soll")).alias("soll_txt"),
        F.when(is_ms, _de_text(booked_h)).alias("ist_txt"),
        "budget_txt", "sollhonorar_txt", null.alias("billed_txt"), "cost_txt",
    )


def positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    supp = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    pos = F.element_at(F.array(*[F.lit(p) for p in K.POSITIONS]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return supp.select(F.col("s_name").alias("staff_name"), pos.alias("position"))


def adjustments(spark: SparkSession, sf_dir: str, quarter: str = REPORT_QUARTER,
                month_hours: DataFrame | None = None) -> DataFrame:
    """Adjustments of the report quarter: employees with suppkey % 3 = 0 give half
    of each month row away to the alphabetically first other employee on the same
    project, milestone and month (null when alone)."""
    if month_hours is None:
        from ..operators.bookings import in_quarter

        e = in_quarter(bookings(spark, sf_dir), S.parse_quarter(quarter))
        month_hours = e.groupBy("staff_name", "proj_norm", "ms_norm", "month").agg(
            F.sum("hours").cast(S.HOURS).alias("hours")
        )
    report = ["report"] if "report" in month_hours.columns else []
    rows = month_hours.select(*report, "staff_name", "proj_norm", "ms_norm", "month", "hours")
    supp = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("staff_name"), "s_suppkey")
    givers = rows.join(supp, "staff_name").where(F.col("s_suppkey") % 3 == 0)
    keys = [*report, "proj_norm", "ms_norm", "month"]
    # The first other employee is the smallest name unless that is oneself, then
    # the second smallest: two aggregates per key, no pairs are formed.
    first = rows.groupBy(*keys).agg(F.min("staff_name").alias("first"))
    second = (
        rows.join(first, keys)
        .where(F.col("staff_name") != F.col("first"))
        .groupBy(*keys)
        .agg(F.min("staff_name").alias("second"))
    )
    return (
        givers.join(first, keys).join(second, keys, "left")
        .select(
            "staff_name", *keys,
            (-(F.col("hours") * F.lit(Decimal("0.5")))).cast(S.HOURS).alias("adj_h"),
            F.when(F.col("first") != F.col("staff_name"), F.col("first")).otherwise(F.col("second")).alias("assign_to"),
        )
    )
