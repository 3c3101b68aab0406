"""DuckDB SQL oracles for the registered queries.

Written independently of the Spark code, straight from the model: the bridge
(FIXTURES.md section 4) as CTEs, then one SELECT per query.  Aliases equal the
Spark column names.  Hours/money are DECIMAL(18,2); percentages DOUBLE rounded
to 2 places; dates DATE.
"""

from __future__ import annotations

from ..functions import constants as K
from ..sources import bridge as B

Q_START = "DATE '1998-07-01'"
Q_END = "DATE '1998-09-30'"
RANGE_START = "DATE '1998-01-01'"
RANGE_END = "DATE '1998-12-31'"


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _case_type(names: list[str]) -> str:
    return "CASE ptype " + " ".join(
        f"WHEN {_lit(t)} THEN {_lit(n)}" for t, n in zip(B.PART_TYPES, names)
    ) + " END"


_SPECIAL = list(K.MONTHLY_BUDGETS) + list(K.QUARTERLY_BUDGETS)
MS_EXPR = f"CASE WHEN n <= 2 THEN {_case_type(_SPECIAL)} ELSE {_case_type(B.REGULAR_MILESTONES)} END"
PROJ_EXPR = ("CASE WHEN n = 1 THEN '0000 Intern' WHEN n = 2 THEN '0000.02 Verwaltung' "
             "ELSE CAST(n + 1000 AS VARCHAR) || '.01 Projekt ' || CAST(n AS VARCHAR) END")


def norm_ms_sql(x: str) -> str:
    return (f"trim(regexp_replace(regexp_replace(coalesce({x}, ''), '[•●]', '', 'g'), "
            f"'^[-\\s]+', ''))")


BOOKINGS = f"""
bk0 AS (
  SELECT s.s_name AS staff_name, CAST(substr(p.p_brand, 7) AS INTEGER) AS n, p.p_type AS ptype,
         CAST(l.l_shipdate AS DATE) AS booked_on, CAST(l.l_quantity * 0.25 AS DECIMAL(18,2)) AS hours
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
),
bookings AS (
  SELECT staff_name, {PROJ_EXPR} AS project, {MS_EXPR} AS work_package_name, booked_on, hours,
         CAST(date_trunc('month', booked_on) AS DATE) AS month,
         CAST(date_trunc('quarter', booked_on) AS DATE) AS quarter
  FROM bk0
),
entries AS (
  SELECT *, trim(project) AS proj_norm, {norm_ms_sql('work_package_name')} AS ms_norm FROM bookings
)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


SQL: dict[str, str] = {}

SQL["project_summary"] = with_(BOOKINGS) + """
SELECT proj_norm, staff_name, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
FROM entries GROUP BY proj_norm, staff_name"""

SQL["employee_summary"] = with_(BOOKINGS) + """
SELECT staff_name, proj_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
FROM entries GROUP BY staff_name, proj_norm"""

SQL["date_range_filter"] = with_(BOOKINGS) + f"""
SELECT proj_norm, staff_name, CAST(sum(hours) AS DECIMAL(18,2)) AS hours, count(*) AS n_entries
FROM entries WHERE booked_on BETWEEN {RANGE_START} AND {RANGE_END}
GROUP BY proj_norm, staff_name"""

SQL["project_prefix_filter"] = with_(BOOKINGS) + """
SELECT staff_name, proj_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
FROM entries
WHERE proj_norm IN ('1003', '0000 Intern', '1017.01') OR starts_with(proj_norm, '1003')
   OR starts_with(proj_norm, '0000 Intern') OR starts_with(proj_norm, '1017.01')
GROUP BY staff_name, proj_norm"""

SQL["employee_filter"] = with_(BOOKINGS) + """
SELECT staff_name, proj_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
FROM entries
WHERE staff_name IN ('Supplier#000000001', 'Supplier#000000007', 'Supplier#000000042')
GROUP BY staff_name, proj_norm"""

SQL["project_list_filter"] = with_(BOOKINGS) + """,
listed AS (
  SELECT DISTINCT CASE WHEN n = 1 THEN '0000 I' WHEN n % 2 = 1 THEN CAST(n + 1000 AS VARCHAR)
                       ELSE CAST(n + 1000 AS VARCHAR) || '.01 Projekt ' || CAST(n AS VARCHAR) END AS prefix
  FROM (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part) WHERE n % 2 = 1 OR n % 10 = 4)
SELECT staff_name, proj_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
FROM entries
WHERE EXISTS (SELECT 1 FROM listed WHERE starts_with(proj_norm, prefix))
  AND staff_name IN (SELECT s_name FROM supplier WHERE s_suppkey % 2 = 0)
GROUP BY staff_name, proj_norm"""

SQL["exclude_special"] = with_(BOOKINGS) + """
SELECT proj_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours, count(DISTINCT staff_name) AS n_staff
FROM entries WHERE NOT regexp_matches(proj_norm, '^0\\.?0+')
GROUP BY proj_norm"""

SQL["quarters_available"] = with_(BOOKINGS) + """
SELECT quarter, list_sort(list(month)) AS months, count(*) AS n_months
FROM (SELECT DISTINCT quarter, month FROM entries WHERE month IS NOT NULL)
GROUP BY quarter"""

SQL["latest_quarter"] = with_(BOOKINGS) + """
SELECT quarter, list_sort(list(month)) AS months, count(*) AS n_months
FROM (SELECT DISTINCT quarter, month FROM entries WHERE month IS NOT NULL)
WHERE quarter = (SELECT max(quarter) FROM entries)
GROUP BY quarter"""

SQL["month_hours"] = with_(BOOKINGS) + f"""
SELECT staff_name, quarter, month, proj_norm, ms_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
FROM entries WHERE quarter = {Q_START}
GROUP BY staff_name, quarter, month, proj_norm, ms_norm"""

_GERMAN_MONTHS_SQL = "[" + ", ".join(_lit(m) for m in K.GERMAN_MONTHS) + "]"


def month_label_sql(d: str) -> str:
    return f"({_GERMAN_MONTHS_SQL})[month({d})] || ' ' || CAST(year({d}) AS VARCHAR)"


SQL["month_blocks"] = with_(BOOKINGS) + f"""
SELECT DISTINCT {month_label_sql('month')} AS block_name, month AS block_start, last_day(month) AS block_end
FROM entries WHERE booked_on BETWEEN {RANGE_START} AND {RANGE_END}"""

SQL["week_blocks"] = with_(BOOKINGS) + f"""
SELECT iso_year, iso_week,
       'KW ' || CAST(iso_week AS VARCHAR) || ' (' || strftime(block_start, '%d.%m') || ' - '
             || strftime(block_end, '%d.%m.%Y') || ')' AS block_name,
       block_start, block_end
FROM (SELECT CAST(isoyear(booked_on) AS INTEGER) AS iso_year, CAST(weekofyear(booked_on) AS INTEGER) AS iso_week,
             min(booked_on) AS block_start, max(booked_on) AS block_end
      FROM entries WHERE booked_on BETWEEN {RANGE_START} AND {RANGE_END}
      GROUP BY 1, 2)"""

SQL["period_block"] = with_(BOOKINGS) + f"""
SELECT '01.01.1998 - 31.12.1998' AS block_name, {RANGE_START} AS block_start, {RANGE_END} AS block_end,
       staff_name, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
FROM entries WHERE booked_on BETWEEN {RANGE_START} AND {RANGE_END}
GROUP BY staff_name"""

SQL["total_block"] = with_(BOOKINGS) + f"""
SELECT 'Gesamt' AS block_name, {RANGE_START} AS block_start, {RANGE_END} AS block_end,
       proj_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
FROM entries WHERE booked_on BETWEEN {RANGE_START} AND {RANGE_END}
GROUP BY proj_norm"""

MONTH_ROWS_BASE = f"""
mh AS (
  SELECT staff_name, quarter, month, proj_norm, ms_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
  FROM entries WHERE quarter = {Q_START}
  GROUP BY staff_name, quarter, month, proj_norm, ms_norm
)"""

SQL["cumulative_quarter_hours"] = with_(BOOKINGS, MONTH_ROWS_BASE) + """
SELECT staff_name, quarter, month, proj_norm, ms_norm, hours,
       CAST(sum(hours) OVER (PARTITION BY staff_name, proj_norm, ms_norm, quarter ORDER BY month
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS cum_hours
FROM mh"""

FUTURE = f"""
km AS (
  SELECT proj_norm, ms_norm, quarter, month, sum(hours) AS key_hours
  FROM entries WHERE quarter = {Q_START} GROUP BY proj_norm, ms_norm, quarter, month
),
fut AS (
  SELECT proj_norm, ms_norm, quarter, month,
         CAST(coalesce(sum(key_hours) OVER (PARTITION BY proj_norm, ms_norm, quarter ORDER BY month
              ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS DECIMAL(18,2)) AS future_hours
  FROM km
)"""

SQL["future_hours_all_staff"] = with_(BOOKINGS, FUTURE) + "SELECT * FROM fut"


# ------------------------------------------------------------ budget export

_TYPES_VALUES = ", ".join(f"({_lit(t)}, {i + 2})" for i, t in enumerate(B.PART_TYPES))


def de_sql(x: str) -> str:
    s = f"replace(replace(trim({x}), '.', ''), ',', '.')"
    return f"(CASE WHEN regexp_full_match({s}, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST({s} AS DECIMAL(30,8)) END)"


BUDGET_LINES = f"""
brands AS (SELECT DISTINCT CAST(substr(p_brand, 7) AS INTEGER) AS n FROM part),
booked AS (
  SELECT CAST(substr(p.p_brand, 7) AS INTEGER) AS n, p.p_type AS ptype,
         CAST(sum(CAST(l.l_quantity * 0.25 AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS booked
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
  WHERE CAST(l.l_shipdate AS DATE) <= {Q_END}
  GROUP BY 1, 2
),
types AS (SELECT * FROM (VALUES {_TYPES_VALUES}) t(ptype, k)),
raw_lines AS (
  SELECT n, 0 AS k, {PROJ_EXPR} AS projekte, NULL AS flag, '-' AS package, NULL AS soll_txt, NULL AS ist_txt,
         NULL AS budget_txt, NULL AS sollhonorar_txt, NULL AS billed_txt, NULL AS cost_txt FROM brands
  UNION ALL
  SELECT n, 1, NULL, 'X', CASE n % 3 WHEN 0 THEN '(p) 1 Paket' WHEN 1 THEN '(aN) 1 Paket' ELSE '1 Paket' END,
         NULL, NULL, NULL, CAST(n * 1000 AS VARCHAR) || ',00', NULL, CAST(n * 100 AS VARCHAR) || ',00' FROM brands
  UNION ALL
  SELECT b.n, t.k, NULL, NULL, '• ' || (CASE WHEN b.n <= 2 THEN {_case_type(_SPECIAL).replace('ptype', 't.ptype')}
                                             ELSE {_case_type(B.REGULAR_MILESTONES).replace('ptype', 't.ptype')} END),
         CASE WHEN b.n <> 2 THEN replace(CAST(CAST(coalesce(bk.booked, 0) * (0.8 + 0.1 * (b.n % 5)) AS DECIMAL(18,2)) AS VARCHAR), '.', ',') END,
         CASE WHEN b.n <> 2 THEN replace(CAST(coalesce(bk.booked, CAST(0 AS DECIMAL(18,2))) AS VARCHAR), '.', ',') END,
         NULL, NULL, NULL, NULL
  FROM brands b CROSS JOIN types t LEFT JOIN booked bk ON bk.n = b.n AND bk.ptype = t.ptype
  UNION ALL
  SELECT n, k, NULL, NULL, pk, '10,00', NULL, bt, NULL, NULL, NULL
  FROM brands CROSS JOIN (VALUES (8, '''   SV', '900,00'), (9, '''   CAD', '700,00'), (10, '''   ADM', '500,00')) r(k, pk, bt)
  UNION ALL
  SELECT n, 11, NULL, NULL, 'NAT 01 Zusatz', '8,00', NULL, '400,00', NULL, NULL, NULL FROM brands WHERE n % 5 = 0
  UNION ALL
  SELECT n, k, NULL, NULL, '• 2.' || CAST(k AS VARCHAR) || ' Position', '0,125', NULL, NULL, NULL, NULL, NULL
  FROM brands CROSS JOIN (SELECT unnest(range(20, 200)) AS k) WHERE n % 7 = 0
  UNION ALL
  SELECT n, 200, NULL, NULL, '''   SV', '4,00', NULL, '380,00', NULL, NULL, NULL FROM brands WHERE n % 7 = 0
  UNION ALL
  SELECT n, 201, NULL, NULL, 'NAT 02 Zusatz', '2,00', NULL, '150,00', NULL, NULL, NULL FROM brands WHERE n % 7 = 0
),
budget_lines AS (
  SELECT 'bridge/budget.csv' AS file_path, CAST(n * 65526 + k AS BIGINT) AS row_no, projekte, flag, package,
         soll_txt, ist_txt, budget_txt, sollhonorar_txt, billed_txt, cost_txt
  FROM raw_lines
),
bl1 AS (
  SELECT *,
    last_value(CASE WHEN trim(projekte) <> '' THEN projekte END IGNORE NULLS) OVER (
      PARTITION BY file_path ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS proj_filled,
    last_value(CASE WHEN trim(projekte) <> '' THEN projekte END IGNORE NULLS) OVER (
      PARTITION BY file_path ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS proj_before,
    row_number() OVER (PARTITION BY file_path ORDER BY row_no) - 1 AS pos,
    trim(coalesce(package, '')) AS pkg,
    upper(trim(coalesce(flag, ''))) = 'X' AS flag_x,
    {de_sql('soll_txt')} AS soll, {de_sql('ist_txt')} AS ist, {de_sql('budget_txt')} AS budget,
    {de_sql('sollhonorar_txt')} AS sollhonorar, {de_sql('billed_txt')} AS billed, {de_sql('cost_txt')} AS cost
  FROM budget_lines
),
bl2 AS (
  SELECT *, coalesce(trim(proj_filled), '') AS projekt, trim(proj_before) AS prev_projekt,
         {norm_ms_sql('pkg')} AS ms, (pkg = '' OR pkg = '-') AS dash_empty
  FROM bl1
),
bl3 AS (
  SELECT *, (prev_projekt IS NULL OR projekt <> prev_projekt) AS changed, (flag_x AND NOT dash_empty) AS is_top
  FROM bl2
),
bl4 AS (
  SELECT *,
    last_value(CASE WHEN is_top THEN pos END IGNORE NULLS) OVER (
      PARTITION BY file_path ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x_pos,
    last_value(CASE WHEN NOT dash_empty AND ms <> '' AND flag_x THEN ms
                    WHEN changed OR dash_empty THEN chr(0) END IGNORE NULLS) OVER (
      PARTITION BY file_path ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS parent_raw
  FROM bl3
),
lines AS (
  SELECT *, CASE WHEN parent_raw <> chr(0) THEN parent_raw END AS parent_run,
         (NOT is_top AND NOT dash_empty AND x_pos IS NOT NULL) AS in_section,
         (contains(pkg, '''   SV') OR contains(pkg, '''   S V')) AS m_sv,
         (contains(pkg, '''   CAD') OR contains(pkg, '''   C A D')) AS m_cad,
         (contains(pkg, '''   ADM') OR contains(pkg, '''   A D M')) AS m_adm
  FROM bl4
),
top AS (
  SELECT file_path, x_pos, projekt AS project, regexp_extract(projekt, '^(\\S+)', 1) AS project_code,
         pkg AS top_milestone, ms AS top_norm,
         CASE WHEN package IS NULL THEN 'Unbekannt'
              WHEN contains(lower(package), '(p)') THEN 'Pauschale'
              WHEN contains(lower(package), '(an)') OR contains(lower(package), '(a.n.)') OR contains(lower(package), '(a n)') THEN 'Nachweis'
              ELSE 'Unbekannt' END AS billing,
         sollhonorar AS total_budget, billed, cost, soll AS own_soll, ist AS actual_hours
  FROM lines WHERE is_top
),
sec AS (
  SELECT file_path, x_pos,
         sum(CASE WHEN soll > 0 THEN soll END) AS sub_soll, max(pos) AS last_pos,
         arg_max(CAST(budget AS DOUBLE) / CAST(soll AS DOUBLE), pos) FILTER (WHERE m_sv AND soll > 0) AS rate_sv,
         arg_max(CAST(budget AS DOUBLE) / CAST(soll AS DOUBLE), pos) FILTER (WHERE NOT m_sv AND m_cad AND soll > 0) AS rate_cad,
         arg_max(CAST(budget AS DOUBLE) / CAST(soll AS DOUBLE), pos) FILTER (WHERE NOT m_sv AND NOT m_cad AND m_adm AND soll > 0) AS rate_adm
  FROM lines WHERE in_section GROUP BY file_path, x_pos
),
main_rec AS (
  SELECT t.file_path, 1 AS kind, 2 * coalesce(s.last_pos, t.x_pos) + 1 AS emit_ord, project, project_code, top_milestone, top_norm, billing,
         total_budget, billed, cost,
         CAST(CASE WHEN sub_soll > 0 THEN sub_soll ELSE own_soll END AS DECIMAL(30,8)) AS target_hours, actual_hours,
         coalesce(rate_sv, CASE WHEN billing = 'Pauschale' AND own_soll > 0 THEN CAST(total_budget AS DOUBLE) / CAST(own_soll AS DOUBLE) END) AS rate_sv,
         coalesce(rate_cad, CASE WHEN billing = 'Pauschale' AND own_soll > 0 THEN CAST(total_budget AS DOUBLE) / CAST(own_soll AS DOUBLE) END) AS rate_cad,
         coalesce(rate_adm, CASE WHEN billing = 'Pauschale' AND own_soll > 0 THEN CAST(total_budget AS DOUBLE) / CAST(own_soll AS DOUBLE) END) AS rate_adm
  FROM top t LEFT JOIN sec s ON s.file_path = t.file_path AND s.x_pos = t.x_pos
),
supp0 AS (
  SELECT l.file_path, l.x_pos, l.pos, l.pkg AS top_milestone, l.ms AS top_norm,
         CASE WHEN contains(lower(l.package), '(p)') THEN 'Pauschale'
              WHEN contains(lower(l.package), '(an)') OR contains(lower(l.package), '(a.n.)') OR contains(lower(l.package), '(a n)') THEN 'Nachweis'
              ELSE 'Unbekannt' END AS own_billing,
         coalesce(CASE WHEN l.budget <> 0 THEN l.budget END, CASE WHEN l.sollhonorar <> 0 THEN l.sollhonorar END) AS fee,
         l.billed, l.cost, l.soll, l.ist
  FROM lines l
  WHERE l.in_section AND regexp_matches(lower(l.pkg), 'nat|nachtrag')
),
supp_rec AS (
  SELECT s.file_path, 0 AS kind, 2 * s.pos AS emit_ord, t.project, t.project_code, s.top_milestone, s.top_norm,
         CASE WHEN s.own_billing = 'Unbekannt' THEN t.billing ELSE s.own_billing END AS billing,
         s.fee AS total_budget, s.billed, s.cost, CAST(s.soll AS DECIMAL(30,8)) AS target_hours, s.ist AS actual_hours,
         CASE WHEN s.soll > 0 THEN CAST(s.fee AS DOUBLE) / CAST(s.soll AS DOUBLE) END AS rate_sv,
         CASE WHEN s.soll > 0 THEN CAST(s.fee AS DOUBLE) / CAST(s.soll AS DOUBLE) END AS rate_cad,
         CASE WHEN s.soll > 0 THEN CAST(s.fee AS DOUBLE) / CAST(s.soll AS DOUBLE) END AS rate_adm
  FROM supp0 s JOIN top t ON t.file_path = s.file_path AND t.x_pos = s.x_pos
  WHERE s.fee IS NOT NULL
),
cand AS (
  SELECT * FROM main_rec UNION ALL SELECT * FROM supp_rec
),
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY file_path, project, top_norm ORDER BY emit_ord) AS rn FROM cand)
  WHERE rn = 1
),
records AS (
  SELECT file_path, project, project_code, top_milestone, top_norm, billing,
         CAST(total_budget AS DECIMAL(30,8)) AS total_budget, CAST(billed AS DECIMAL(30,8)) AS billed,
         CAST(cost AS DECIMAL(30,8)) AS cost, CAST(target_hours AS DECIMAL(30,8)) AS target_hours,
         CAST(actual_hours AS DECIMAL(30,8)) AS actual_hours, rate_sv, rate_cad, rate_adm,
         project || '||' || top_norm AS lookup_key,
         CAST(row_number() OVER (PARTITION BY file_path ORDER BY emit_ord) AS INTEGER) AS lookup_id, kind
  FROM kept
),
edges AS (
  SELECT file_path, projekt, ms AS ms_norm, parent_run AS parent FROM lines
  WHERE NOT dash_empty AND ms <> '' AND parent_run IS NOT NULL
  UNION ALL
  SELECT file_path, project, top_norm, top_norm FROM records WHERE kind = 0
),
pmap AS (
  SELECT project_key, ms_norm, list_sort(list(DISTINCT parent)) AS parents
  FROM (SELECT unnest(list_distinct(list_filter([projekt, regexp_extract(projekt, '^(\\S+)', 1)], lambda x: x <> ''))) AS project_key,
               ms_norm, parent FROM edges)
  GROUP BY project_key, ms_norm
),
plan AS (
  SELECT projekt AS proj_norm, ms AS ms_norm,
         CAST(coalesce(sum(soll), 0) AS DECIMAL(30,8)) AS soll, CAST(coalesce(sum(ist), 0) AS DECIMAL(30,8)) AS ist
  FROM lines WHERE package IS NOT NULL AND pkg <> '-' AND pkg <> '' AND proj_filled IS NOT NULL
  GROUP BY projekt, ms
)"""

SQL["plan_actual"] = with_(BUDGET_LINES) + """
SELECT proj_norm, ms_norm, CAST(soll AS DECIMAL(18,2)) AS soll, CAST(ist AS DECIMAL(18,2)) AS ist,
       round(CASE WHEN soll > 0 THEN CAST(ist AS DOUBLE) / CAST(soll AS DOUBLE) * 100.0
                  WHEN ist > 0 THEN 999.0 ELSE 0.0 END, 2) AS pct
FROM plan"""

SQL["ffill_project"] = with_(BUDGET_LINES) + """
SELECT row_no, pos, projekt AS project, changed, is_top FROM lines"""

SQL["parent_map"] = with_(BUDGET_LINES) + """
SELECT project_key, ms_norm, parents, CAST(len(parents) AS INTEGER) AS n_parents FROM pmap"""

SQL["section_target_hours"] = with_(BUDGET_LINES) + """
SELECT project, top_norm, lookup_id, CAST(target_hours AS DECIMAL(18,2)) AS target_hours, CAST(actual_hours AS DECIMAL(18,2)) AS actual_hours FROM records"""

SQL["section_rates"] = with_(BUDGET_LINES) + """
SELECT project, top_norm, billing, round(rate_sv, 4) AS rate_sv, round(rate_cad, 4) AS rate_cad,
       round(rate_adm, 4) AS rate_adm FROM records"""

SQL["nachtrag_records"] = with_(BUDGET_LINES) + """
SELECT project, project_code, top_milestone, top_norm, billing, CAST(total_budget AS DECIMAL(18,2)) AS total_budget, CAST(target_hours AS DECIMAL(18,2)) AS target_hours,
       round(rate_sv, 4) AS rate_sv, lookup_id
FROM records WHERE regexp_matches(lower(top_milestone), 'nat|nachtrag')"""

SQL["budget_records"] = with_(BUDGET_LINES) + """
SELECT project, project_code, top_milestone, top_norm, billing, CAST(total_budget AS DECIMAL(18,2)) AS total_budget, CAST(billed AS DECIMAL(18,2)) AS billed, CAST(cost AS DECIMAL(18,2)) AS cost, CAST(target_hours AS DECIMAL(18,2)) AS target_hours,
       CAST(actual_hours AS DECIMAL(18,2)) AS actual_hours, round(rate_sv, 4) AS rate_sv, round(rate_cad, 4) AS rate_cad, round(rate_adm, 4) AS rate_adm,
       lookup_key, lookup_id
FROM records"""

SQL["budget_overview"] = with_(BUDGET_LINES) + """
SELECT project, top_milestone, billing,
       CAST(CASE WHEN target_hours > 0 THEN target_hours END AS DECIMAL(18,2)) AS target_hours,
       CASE WHEN billing <> 'Unbekannt' AND (coalesce(rate_sv > 0, false) OR coalesce(rate_cad > 0, false) OR coalesce(rate_adm > 0, false))
            THEN '✓ Vollständig' ELSE '⚠ Manual erforderlich' END AS status,
       CAST(CASE WHEN total_budget > 0 THEN total_budget END AS DECIMAL(18,2)) AS total_budget,
       CAST(CASE WHEN billed > 0 THEN billed ELSE 0 END AS DECIMAL(18,2)) AS billed,
       CAST(coalesce(total_budget, 0) - coalesce(billed, 0) AS DECIMAL(18,2)) AS available,
       round(rate_sv, 4) AS rate_sv, round(rate_cad, 4) AS rate_cad, round(rate_adm, 4) AS rate_adm,
       concat_ws('; ', CASE WHEN billing = 'Unbekannt' THEN 'Abrechnungsart wählen' END,
                 CASE WHEN NOT (coalesce(rate_sv > 0, false) OR coalesce(rate_cad > 0, false) OR coalesce(rate_adm > 0, false))
                      THEN 'Stundensätze eingeben' END) AS remark,
       lookup_id
FROM records"""


# ------------------------------------------------------------ month rules

_BUDGET_RE = "(?i)(\\d+[\\.,]?\\d*)\\s*h\\s*(?:/|pro\\s+)(monat|quartal)"


def _dict_case(col: str, table: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = {_lit(k)} THEN CAST({v} AS DECIMAL(18,2))" for k, v in table.items()) + " END"


MONTH_RULES = f"""
mh2 AS (
  SELECT *, CAST(sum(hours) OVER (PARTITION BY staff_name, proj_norm, ms_norm, quarter ORDER BY month
            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DECIMAL(18,2)) AS cum_hours
  FROM mh
),
mr0 AS (
  SELECT m.*, coalesce(p.soll, 0) AS csv_soll, coalesce(p.ist, 0) AS csv_ist, coalesce(f.future_hours, 0) AS future_hours,
         CASE WHEN contains(lower(m.ms_norm), 'quartal') THEN 'quarterly' ELSE 'monthly' END AS milestone_type,
         coalesce(starts_with(lower(trim(m.proj_norm)), '0000'), false) AS is_special,
         {_dict_case('m.ms_norm', K.MONTHLY_BUDGETS)} AS mdict_h,
         {_dict_case('m.ms_norm', K.QUARTERLY_BUDGETS)} AS qdict_h,
         CASE WHEN regexp_extract(m.ms_norm, '{_BUDGET_RE}', 2) <> ''
              THEN TRY_CAST(replace(regexp_extract(m.ms_norm, '{_BUDGET_RE}', 1), ',', '.') AS DECIMAL(18,2)) END AS nb_h,
         CASE WHEN regexp_extract(m.ms_norm, '{_BUDGET_RE}', 2) <> ''
              THEN lower(regexp_extract(m.ms_norm, '{_BUDGET_RE}', 2)) END AS nb_unit
  FROM mh2 m LEFT JOIN plan p ON p.proj_norm = m.proj_norm AND p.ms_norm = m.ms_norm
       LEFT JOIN fut f ON f.proj_norm = m.proj_norm AND f.ms_norm = m.ms_norm AND f.quarter = m.quarter AND f.month = m.month
),
mr1 AS (
  SELECT *,
    CASE WHEN milestone_type = 'monthly' AND mdict_h IS NOT NULL AND ((csv_soll = 0 AND csv_ist = 0) OR is_special)
         THEN mdict_h ELSE csv_soll END AS soll1,
    CASE WHEN milestone_type = 'monthly' AND mdict_h IS NOT NULL AND ((csv_soll = 0 AND csv_ist = 0) OR is_special)
         THEN hours ELSE csv_ist END AS ist1
  FROM mr0
),
mr2 AS (
  SELECT *,
    CAST(CASE WHEN milestone_type = 'monthly' THEN
           CASE WHEN is_special AND mdict_h IS NOT NULL THEN mdict_h
                WHEN is_special AND nb_unit = 'monat' AND nb_h IS NOT NULL THEN nb_h
                ELSE soll1 END
         ELSE CASE WHEN nb_unit = 'quartal' AND nb_h IS NOT NULL THEN nb_h
                   WHEN qdict_h IS NOT NULL THEN qdict_h
                   WHEN soll1 > 0 THEN soll1 ELSE 0 END END AS DECIMAL(18,2)) AS soll_raw,
    CAST(CASE WHEN milestone_type = 'monthly' THEN
           CASE WHEN is_special THEN hours ELSE ist1 - future_hours END
         ELSE cum_hours END AS DECIMAL(18,2)) AS ist
  FROM mr1
),
mr AS (
  SELECT *, CASE WHEN soll_raw > 0 THEN CAST(ist AS DOUBLE) / CAST(soll_raw AS DOUBLE) * 100.0 ELSE 0.0 END AS pct_raw
  FROM mr2
),
mrows AS (
  SELECT staff_name, quarter, month, proj_norm, ms_norm, milestone_type, is_special, hours,
         CASE WHEN milestone_type = 'quarterly' AND soll_raw = 0 THEN NULL ELSE soll_raw END AS soll,
         ist,
         CASE WHEN milestone_type = 'quarterly' AND soll_raw = 0 THEN NULL ELSE round(pct_raw, 2) END AS pct,
         CASE WHEN soll_raw > 0 THEN pct_raw <= 100.0 ELSE true END AS eligible,
         CASE WHEN soll_raw > 0 THEN CASE WHEN pct_raw < 90 THEN 'green' WHEN pct_raw <= 100 THEN 'yellow' ELSE 'red' END END AS status,
         soll_raw AS target_for_revenue
  FROM mr
)"""

ADJ = """
firsts AS (SELECT proj_norm, ms_norm, month, min(staff_name) AS first FROM mh GROUP BY proj_norm, ms_norm, month),
seconds AS (
  SELECT m.proj_norm, m.ms_norm, m.month, min(m.staff_name) AS second
  FROM mh m JOIN firsts f ON f.proj_norm = m.proj_norm AND f.ms_norm = m.ms_norm AND f.month = m.month
  WHERE m.staff_name <> f.first GROUP BY m.proj_norm, m.ms_norm, m.month
),
adjustments AS (
  SELECT g.staff_name, g.proj_norm, g.ms_norm, g.month, CAST(-(g.hours * 0.5) AS DECIMAL(18,2)) AS adj_h,
         CASE WHEN f.first <> g.staff_name THEN f.first ELSE s.second END AS assign_to
  FROM mh g JOIN supplier sp ON sp.s_name = g.staff_name
       JOIN firsts f ON f.proj_norm = g.proj_norm AND f.ms_norm = g.ms_norm AND f.month = g.month
       LEFT JOIN seconds s ON s.proj_norm = g.proj_norm AND s.ms_norm = g.ms_norm AND s.month = g.month
  WHERE sp.s_suppkey % 3 = 0
)"""

ADJUST = ADJ + """,
ra0 AS (
  SELECT r.*, a.adj_h, a.assign_to,
         CAST(CASE WHEN a.adj_h < 0 THEN greatest(CAST(0 AS DECIMAL(18,2)), least(r.hours, -a.adj_h)) ELSE 0 END AS DECIMAL(18,2)) AS transferable
  FROM mrows r LEFT JOIN adjustments a
    ON a.staff_name = r.staff_name AND a.proj_norm = r.proj_norm AND a.ms_norm = r.ms_norm AND a.month = r.month
),
recv AS (
  SELECT proj_norm, ms_norm, month, assign_to AS staff_name, CAST(sum(transferable) AS DECIMAL(18,2)) AS from_others
  FROM ra0 WHERE assign_to IS NOT NULL AND assign_to <> staff_name GROUP BY proj_norm, ms_norm, month, assign_to
),
ra AS (
  SELECT ra0.*, CAST(coalesce(recv.from_others, 0) AS DECIMAL(18,2)) AS from_others
  FROM ra0 LEFT JOIN recv ON recv.staff_name = ra0.staff_name AND recv.proj_norm = ra0.proj_norm
       AND recv.ms_norm = ra0.ms_norm AND recv.month = ra0.month
),
totals AS (
  SELECT staff_name, quarter, month,
         CAST(coalesce(sum(hours), 0) AS DECIMAL(18,2)) AS total_hours,
         CAST(coalesce(sum(CASE WHEN eligible AND NOT is_special THEN hours END), 0) AS DECIMAL(18,2)) AS bonus_base,
         CAST(coalesce(sum(CASE WHEN eligible AND is_special THEN hours END), 0) AS DECIMAL(18,2)) AS special_base,
         CAST(coalesce(sum(CASE WHEN NOT is_special THEN adj_h END), 0) AS DECIMAL(18,2)) AS adj_regular,
         CAST(coalesce(sum(CASE WHEN is_special THEN adj_h END), 0) AS DECIMAL(18,2)) AS adj_special,
         CAST(coalesce(sum(from_others), 0) AS DECIMAL(18,2)) AS assigned
  FROM ra GROUP BY staff_name, quarter, month
),
totals2 AS (
  SELECT *, CAST(bonus_base + adj_regular AS DECIMAL(18,2)) AS bonus_total,
         CAST(special_base + adj_special AS DECIMAL(18,2)) AS special_total,
         CAST(bonus_base + adj_regular + special_base + adj_special + assigned AS DECIMAL(18,2)) AS total_bonus
  FROM totals
)"""

RULES = with_(BOOKINGS, BUDGET_LINES, MONTH_ROWS_BASE, FUTURE, MONTH_RULES)
RULES_ADJ = with_(BOOKINGS, BUDGET_LINES, MONTH_ROWS_BASE, FUTURE, MONTH_RULES, ADJUST)

SQL["month_rows"] = RULES + """
SELECT staff_name, quarter, month, proj_norm, ms_norm, milestone_type, is_special, hours, soll, ist, pct, eligible, status
FROM mrows"""

SQL["coworkers"] = RULES + """
SELECT r.proj_norm, r.ms_norm, r.month, r.staff_name, n.n_staff, n.n_staff - 1 AS n_others
FROM mrows r JOIN (SELECT proj_norm, ms_norm, month, count(DISTINCT staff_name) AS n_staff FROM mrows
                   GROUP BY proj_norm, ms_norm, month) n
  ON n.proj_norm = r.proj_norm AND n.ms_norm = r.ms_norm AND n.month = r.month"""

SQL["hour_transfers"] = RULES_ADJ + """
SELECT staff_name, month, proj_norm, ms_norm, hours, adj_h, assign_to, transferable, from_others
FROM ra WHERE adj_h IS NOT NULL OR from_others > 0"""

SQL["month_totals"] = RULES_ADJ + """
SELECT staff_name, month, total_hours, bonus_base, special_base FROM totals2"""

SQL["bonus_totals"] = RULES_ADJ + """
SELECT staff_name, month, bonus_base, adj_regular, bonus_total, special_base, adj_special, special_total,
       assigned, total_bonus
FROM totals2"""

_OF_ALL = "FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey\n),\nbookings"


def _per_file_sql(name: str) -> str:
    """The single report of every file, one after another."""
    of_file = "FROM (SELECT * FROM lineitem WHERE l_orderkey % 3 = {}) l JOIN part"
    return " UNION ALL ".join(
        f"SELECT 'times-{f}' AS report, * FROM ({SQL[name].replace(_OF_ALL, _OF_ALL.replace('FROM lineitem l JOIN part', of_file.format(f)))})"
        for f in range(3))


SQL["per_file_report"] = _per_file_sql("bonus_totals")
SQL["per_file_month_rows"] = _per_file_sql("month_rows")

SQL["transfer_sheet"] = RULES_ADJ + f"""
SELECT staff_name, {month_label_sql('month')} AS month_label, total_hours, bonus_total, special_total, assigned, total_bonus
FROM totals2"""

SQL["quarter_totals"] = RULES_ADJ + """
SELECT staff_name, quarter,
       CAST(sum(total_hours) AS DECIMAL(18,2)) AS total_hours, CAST(sum(bonus_base) AS DECIMAL(18,2)) AS bonus_base,
       CAST(sum(special_base) AS DECIMAL(18,2)) AS special_base, CAST(sum(bonus_total) AS DECIMAL(18,2)) AS bonus_total,
       CAST(sum(special_total) AS DECIMAL(18,2)) AS special_total, CAST(sum(assigned) AS DECIMAL(18,2)) AS assigned,
       CAST(sum(total_bonus) AS DECIMAL(18,2)) AS total_bonus, count(*) AS n_months
FROM totals2 GROUP BY staff_name, quarter"""


def _keys_sql(name: str) -> str:
    code = f"regexp_extract({name}, '^(\\S+)', 1)"
    return (f"(CASE WHEN {name} = '' THEN CAST([] AS VARCHAR[]) WHEN {code} = {name} OR {code} = '' THEN [{name}] "
            f"ELSE [{name}, {code}] END)")


RESOLVE = f"""
rkeys AS (SELECT DISTINCT proj_norm, ms_norm FROM mh),
kk0 AS (SELECT proj_norm, ms_norm, {_keys_sql('proj_norm')} AS keys FROM rkeys),
kk AS (
  SELECT proj_norm, ms_norm, unnest(keys) AS key, unnest(generate_series(0, len(keys) - 1)) AS kpos FROM kk0
),
kkp AS (
  SELECT kk.*, pm.parents, CAST(len(pm.parents) AS INTEGER) AS n_parents
  FROM kk LEFT JOIN pmap pm ON pm.project_key = kk.key AND pm.ms_norm = kk.ms_norm
),
lt AS (
  SELECT key, cand_ms, max(lookup_id) AS rid FROM (
    SELECT unnest({_keys_sql('project')}) AS key, top_norm AS cand_ms, lookup_id FROM records
    WHERE project NOT IN ('', '-', 'nan') AND top_norm <> '')
  GROUP BY key, cand_ms
),
cands AS (
  SELECT proj_norm, ms_norm, kpos * 2 AS prio, key, ms_norm AS cand_ms FROM kkp
  UNION ALL
  SELECT proj_norm, ms_norm, kpos * 2 + 1, key, parents[1] FROM kkp WHERE n_parents = 1
),
j3 AS (
  SELECT c.proj_norm, c.ms_norm, arg_min(lt.rid, c.prio) AS res_id
  FROM cands c JOIN lt ON lt.key = c.key AND lt.cand_ms = c.cand_ms GROUP BY c.proj_norm, c.ms_norm
),
idt AS (
  SELECT ({_keys_sql('project')})[-1] AS key, top_norm AS cand_ms, max(lookup_id) AS lid FROM records
  WHERE project NOT IN ('', '-', 'nan') AND top_norm <> '' GROUP BY 1, 2
),
prim AS (
  SELECT k.proj_norm, k.ms_norm, arg_min(i.lid, k.kpos) AS primary_id
  FROM kk k JOIN idt i ON i.key = k.key AND i.cand_ms = k.ms_norm GROUP BY k.proj_norm, k.ms_norm
),
par AS (
  SELECT proj_norm, ms_norm, arg_min(parents[1], kpos) AS fb_parent FROM kkp WHERE n_parents >= 1
  GROUP BY proj_norm, ms_norm
),
fb AS (
  SELECT k.proj_norm, k.ms_norm, arg_min(i.lid, k.kpos) AS fallback_id
  FROM kk k JOIN par p ON p.proj_norm = k.proj_norm AND p.ms_norm = k.ms_norm
       JOIN idt i ON i.key = k.key AND i.cand_ms = p.fb_parent
  GROUP BY k.proj_norm, k.ms_norm
),
res0 AS (
  SELECT r.proj_norm, r.ms_norm, j3.res_id, prim.primary_id, fb.fallback_id,
         coalesce(prim.primary_id, fb.fallback_id) AS lookup_id
  FROM rkeys r LEFT JOIN j3 ON j3.proj_norm = r.proj_norm AND j3.ms_norm = r.ms_norm
       LEFT JOIN prim ON prim.proj_norm = r.proj_norm AND prim.ms_norm = r.ms_norm
       LEFT JOIN fb ON fb.proj_norm = r.proj_norm AND fb.ms_norm = r.ms_norm
),
res AS (
  SELECT r.proj_norm, r.ms_norm, r.res_id, r.lookup_id,
         CASE WHEN r.lookup_id IS NOT NULL THEN coalesce(b.billing, '') ELSE 'Unbekannt' END AS billing,
         b.rate_sv, b.rate_cad, b.rate_adm, coalesce(b.total_budget, CAST(0 AS DECIMAL(18,2))) AS budget_total,
         CASE WHEN (CASE WHEN r.res_id IS NOT NULL THEN r3.target_hours WHEN r.primary_id IS NOT NULL THEN rp.target_hours
                         ELSE rf.target_hours END) <> 0
              THEN (CASE WHEN r.res_id IS NOT NULL THEN r3.target_hours WHEN r.primary_id IS NOT NULL THEN rp.target_hours
                         ELSE rf.target_hours END) END AS target_hours_q,
         CASE WHEN r3.cost <> 0 THEN r3.cost END AS cost_s, coalesce(r3.billing, 'Unbekannt') AS billing_j3
  FROM res0 r LEFT JOIN records b ON b.lookup_id = r.lookup_id
       LEFT JOIN records r3 ON r3.lookup_id = r.res_id
       LEFT JOIN records rp ON rp.lookup_id = r.primary_id
       LEFT JOIN records rf ON rf.lookup_id = r.fallback_id
)"""

SQL["budget_resolve"] = with_(BOOKINGS, BUDGET_LINES, MONTH_ROWS_BASE, RESOLVE) + """
SELECT proj_norm, ms_norm, res_id, CAST(target_hours_q AS DECIMAL(18,2)) AS target_hours_q, CAST(cost_s AS DECIMAL(18,2)) AS cost_s FROM res"""

SQL["lookup_id_resolve"] = with_(BOOKINGS, BUDGET_LINES, MONTH_ROWS_BASE, RESOLVE) + """
SELECT proj_norm, ms_norm, lookup_id, billing, round(rate_sv, 4) AS rate_sv, round(rate_cad, 4) AS rate_cad,
       round(rate_adm, 4) AS rate_adm, CAST(budget_total AS DECIMAL(18,2)) AS budget_total FROM res"""

_POSITIONS_SQL = "[" + ", ".join(_lit(p) for p in K.POSITIONS) + "]"

REVENUE = f"""
positions AS (SELECT s_name AS staff_name, ({_POSITIONS_SQL})[s_suppkey % 5 + 1] AS position FROM supplier),
rv0 AS (
  SELECT ra.*, res.lookup_id, res.billing, res.rate_sv, res.rate_cad, res.rate_adm, res.budget_total,
         coalesce(p.position, 'SV') AS position
  FROM ra LEFT JOIN res ON res.proj_norm = ra.proj_norm AND res.ms_norm = ra.ms_norm
       LEFT JOIN positions p ON p.staff_name = ra.staff_name
),
rv1 AS (
  SELECT *,
    CASE WHEN position = '-' THEN 0.0 WHEN lookup_id IS NULL THEN 0.0
         WHEN position = 'CAD' THEN coalesce(rate_cad, 0.0) WHEN position = 'ADM' THEN coalesce(rate_adm, 0.0)
         ELSE coalesce(rate_sv, 0.0) END AS rate,
    CAST(coalesce(budget_total, 0) AS DOUBLE) AS rr, CAST(coalesce(target_for_revenue, 0) AS DOUBLE) AS dd,
    CAST(coalesce(ist, 0) AS DOUBLE) AS ee, CAST(hours + from_others AS DOUBLE) AS fk
  FROM rv0
),
rv2 AS (
  SELECT *,
    CASE WHEN position = '-' THEN 0.0
         WHEN billing = 'Pauschale' THEN CASE WHEN rr = 0 OR dd = 0 THEN 0.0
                                              ELSE greatest(0.0, least(rr * (fk / dd), rr - rr * (ee / dd))) END
         ELSE rate * fk END AS revenue,
    CASE WHEN position = '-' THEN 0.0
         WHEN billing = 'Pauschale' THEN CASE WHEN rr = 0 OR dd = 0 THEN 0.0 ELSE rr * (fk / dd) END
         ELSE rate * fk END AS possible
  FROM rv1
),
rv AS (
  SELECT rv2.*, rv2.possible - rv2.revenue AS lost, k.revenue_key
  FROM rv2 JOIN (SELECT proj_norm, ms_norm, month, sum(revenue) AS revenue_key FROM rv2 GROUP BY 1, 2, 3) k
    ON k.proj_norm = rv2.proj_norm AND k.ms_norm = rv2.ms_norm AND k.month = rv2.month
)"""

_REV = with_(BOOKINGS, BUDGET_LINES, MONTH_ROWS_BASE, FUTURE, MONTH_RULES, ADJUST, RESOLVE, REVENUE)

SQL["revenue_rows"] = _REV + """
SELECT staff_name, month, proj_norm, ms_norm, position, billing, round(rate, 4) AS rate,
       round(revenue, 2) AS revenue, round(possible, 2) AS possible, round(lost, 2) AS lost,
       round(revenue_key, 2) AS revenue_key
FROM rv"""

SQL["revenue_by_key"] = _REV + """
SELECT proj_norm, ms_norm, month, round(sum(revenue), 2) AS revenue, round(sum(possible), 2) AS possible,
       count(*) AS n_rows
FROM rv GROUP BY proj_norm, ms_norm, month"""

SQL["month_revenue_totals"] = _REV + """
SELECT staff_name, quarter, month, round(sum(revenue), 2) AS revenue, round(sum(possible), 2) AS possible,
       round(sum(lost), 2) AS lost, round(sum(revenue_key), 2) AS revenue_key
FROM rv GROUP BY staff_name, quarter, month"""

SQL["month_rows_one_employee"] = _REV + """
SELECT staff_name, month, proj_norm, ms_norm, hours, soll, ist, pct, eligible, from_others, round(revenue, 2) AS revenue,
       round(revenue_key, 2) AS revenue_key
FROM rv WHERE staff_name = 'Supplier#000000001'"""

SQL["quarter_milestones"] = with_(BOOKINGS, BUDGET_LINES, MONTH_ROWS_BASE) + f"""
, qh AS (
  SELECT staff_name, quarter, proj_norm, ms_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
  FROM mh GROUP BY staff_name, quarter, proj_norm, ms_norm
),
qm AS (
  SELECT q.*, CAST(CASE
      WHEN regexp_extract(q.ms_norm, '{_BUDGET_RE}', 2) <> '' AND lower(regexp_extract(q.ms_norm, '{_BUDGET_RE}', 2)) = 'quartal'
           AND TRY_CAST(replace(regexp_extract(q.ms_norm, '{_BUDGET_RE}', 1), ',', '.') AS DECIMAL(18,2)) IS NOT NULL
        THEN TRY_CAST(replace(regexp_extract(q.ms_norm, '{_BUDGET_RE}', 1), ',', '.') AS DECIMAL(18,2))
      WHEN {_dict_case('q.ms_norm', K.QUARTERLY_BUDGETS)} IS NOT NULL THEN {_dict_case('q.ms_norm', K.QUARTERLY_BUDGETS)}
      WHEN coalesce(p.soll, 0) > 0 THEN p.soll ELSE 0 END AS DECIMAL(18,2)) AS q_soll
  FROM qh q LEFT JOIN plan p ON p.proj_norm = q.proj_norm AND p.ms_norm = q.ms_norm
  WHERE contains(lower(q.ms_norm), 'quartal')
)
SELECT staff_name, quarter, proj_norm, ms_norm, CASE WHEN q_soll > 0 THEN q_soll END AS q_soll, hours AS q_ist,
       CASE WHEN q_soll > 0 THEN round(CAST(hours AS DOUBLE) / CAST(q_soll AS DOUBLE) * 100.0, 2) END AS pct,
       CASE WHEN q_soll > 0 THEN CASE WHEN CAST(hours AS DOUBLE) / CAST(q_soll AS DOUBLE) * 100.0 < 90 THEN 'green'
                                      WHEN CAST(hours AS DOUBLE) / CAST(q_soll AS DOUBLE) * 100.0 <= 100 THEN 'yellow'
                                      ELSE 'red' END END AS status
FROM qm"""

SQL["quarter_summary"] = RULES_ADJ + f"""
, qs0 AS (
  SELECT staff_name, quarter, proj_norm, ms_norm,
         CAST(sum(hours) AS DECIMAL(18,2)) AS q_hours,
         CAST(sum(hours + transferable + from_others) AS DECIMAL(18,2)) AS q_total,
         CAST(sum(coalesce(adj_h, 0)) AS DECIMAL(18,2)) AS q_adj,
         CAST(sum(from_others) AS DECIMAL(18,2)) AS q_from_others
  FROM ra GROUP BY staff_name, quarter, proj_norm, ms_norm
),
qs1 AS (
  SELECT q.*, p.soll AS csv_soll, p.ist AS csv_ist,
         coalesce(starts_with(lower(trim(q.proj_norm)), '0000'), false) AS is_special,
         CASE WHEN regexp_extract(q.ms_norm, '{_BUDGET_RE}', 2) <> ''
              THEN TRY_CAST(replace(regexp_extract(q.ms_norm, '{_BUDGET_RE}', 1), ',', '.') AS DECIMAL(18,2)) END AS nb_h,
         lower(regexp_extract(q.ms_norm, '{_BUDGET_RE}', 2)) AS nb_unit,
         {_dict_case('q.ms_norm', K.QUARTERLY_BUDGETS)} AS qdict_h,
         {_dict_case('q.ms_norm', K.MONTHLY_BUDGETS)} AS mdict_h
  FROM qs0 q JOIN plan p ON p.proj_norm = q.proj_norm AND p.ms_norm = q.ms_norm
),
qs2 AS (
  SELECT *,
    CAST(CASE WHEN is_special THEN
           CASE WHEN nb_unit = 'quartal' AND nb_h IS NOT NULL THEN nb_h
                WHEN nb_unit = 'monat' AND nb_h IS NOT NULL THEN nb_h * 3
                WHEN qdict_h IS NOT NULL THEN qdict_h
                WHEN mdict_h IS NOT NULL THEN mdict_h * 3 ELSE 0 END
         ELSE coalesce(csv_soll, 0) END AS DECIMAL(18,2)) AS q_soll0,
    CAST(CASE WHEN is_special THEN q_hours ELSE coalesce(csv_ist, 0) END AS DECIMAL(18,2)) AS q_ist
  FROM qs1
)
SELECT staff_name, quarter, proj_norm, ms_norm, is_special,
       CASE WHEN q_soll0 > 0 THEN q_soll0 END AS q_soll, q_ist,
       CASE WHEN q_soll0 > 0 THEN round(CAST(q_ist AS DOUBLE) / CAST(q_soll0 AS DOUBLE) * 100.0, 2) END AS pct,
       q_total AS q_hours, q_adj AS adj_h,
       CAST(CASE WHEN q_adj < 0 THEN greatest(CAST(0 AS DECIMAL(18,2)), least(q_total, -q_adj)) ELSE 0 END AS DECIMAL(18,2)) AS transferable,
       q_from_others AS from_others
FROM qs2"""


# ------------------------------------------------------------ reports

SQL["cover_months"] = RULES_ADJ + f"""
, months AS (SELECT DISTINCT month FROM entries WHERE quarter = {Q_START}),
g AS (SELECT month, sum(total_hours) AS th, sum(bonus_total) AS bt, sum(special_total) AS st FROM totals2 GROUP BY month)
SELECT m.month, {month_label_sql('m.month')} AS month_label,
       CAST(coalesce(g.th, 0) AS DECIMAL(18,2)) AS total_hours, CAST(coalesce(g.bt, 0) AS DECIMAL(18,2)) AS bonus_total,
       CAST(coalesce(g.st, 0) AS DECIMAL(18,2)) AS special_total
FROM months m LEFT JOIN g ON g.month = m.month"""

SQL["cover_quarter"] = RULES_ADJ + """
SELECT quarter, CAST(sum(total_hours) AS DECIMAL(18,2)) AS total_hours, CAST(sum(bonus_total) AS DECIMAL(18,2)) AS bonus_total,
       CAST(sum(special_total) AS DECIMAL(18,2)) AS special_total, count(DISTINCT staff_name) AS n_employees
FROM totals2 GROUP BY quarter"""

SQL["quarter_employees"] = with_(BOOKINGS) + f"""
SELECT DISTINCT staff_name FROM entries WHERE quarter = {Q_START}"""

FLEX_START, FLEX_END = "DATE '1998-07-01'", "DATE '1998-12-31'"


def _flex_sql(block_cols: str, extra_where: str = "", extra_cte: str = "", join: str = "") -> str:
    return with_(BOOKINGS, BUDGET_LINES, MONTH_ROWS_BASE, ADJ, RESOLVE.replace("FROM mh)", "FROM entries)")) + f"""
, fe0 AS (
  SELECT e.*, {block_cols} FROM entries e {join}
  WHERE e.booked_on BETWEEN {FLEX_START} AND {FLEX_END} {extra_where}
),
bh AS (
  SELECT staff_name, block_name, block_start, block_end, proj_norm, ms_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
  FROM fe0 GROUP BY staff_name, block_name, block_start, block_end, proj_norm, ms_norm
),
qh AS (
  SELECT staff_name, proj_norm, ms_norm, quarter AS block_quarter, CAST(sum(hours) AS DECIMAL(18,2)) AS quarter_hours
  FROM fe0 GROUP BY staff_name, proj_norm, ms_norm, quarter
),
fadj AS (
  SELECT a.staff_name, a.proj_norm, a.ms_norm, l.block_start, sum(a.adj_h) AS adj_h
  FROM adjustments a JOIN (SELECT staff_name, proj_norm, ms_norm, month, max(block_start) AS block_start FROM fe0
                           GROUP BY staff_name, proj_norm, ms_norm, month) l
    ON l.staff_name = a.staff_name AND l.proj_norm = a.proj_norm AND l.ms_norm = a.ms_norm AND l.month = a.month
  GROUP BY a.staff_name, a.proj_norm, a.ms_norm, l.block_start
),
fx0 AS (
  SELECT b.*, CAST(fa.adj_h AS DECIMAL(18,2)) AS adj_h, fr.billing_j3 AS billing, p.soll AS csv_soll, p.ist AS csv_ist, q.quarter_hours,
         coalesce(starts_with(lower(trim(b.proj_norm)), '0000'), false) AS is_special,
         CAST({_dict_case('b.ms_norm', K.MONTHLY_BUDGETS)} AS DOUBLE) AS mdict,
         CAST({_dict_case('b.ms_norm', K.QUARTERLY_BUDGETS)} AS DOUBLE) AS qdict
  FROM bh b LEFT JOIN plan p ON p.proj_norm = b.proj_norm AND p.ms_norm = b.ms_norm
       LEFT JOIN qh q ON q.staff_name = b.staff_name AND q.proj_norm = b.proj_norm AND q.ms_norm = b.ms_norm
                      AND q.block_quarter = CAST(date_trunc('quarter', b.block_start) AS DATE)
       LEFT JOIN fadj fa ON fa.staff_name = b.staff_name AND fa.proj_norm = b.proj_norm AND fa.ms_norm = b.ms_norm
                         AND fa.block_start = b.block_start
       LEFT JOIN res fr ON fr.proj_norm = b.proj_norm AND fr.ms_norm = b.ms_norm
),
fx1 AS (
  SELECT *,
    CASE WHEN is_special AND mdict IS NOT NULL
           THEN CAST(date_diff('day', block_start, block_end) + 1 AS DOUBLE) / CAST(day(last_day(block_start)) AS DOUBLE) * mdict
         WHEN is_special AND qdict IS NOT NULL THEN qdict
         ELSE CAST(coalesce(csv_soll, 0) AS DOUBLE) END AS soll_d,
    CAST(CASE WHEN is_special AND mdict IS NOT NULL THEN hours
              WHEN is_special AND qdict IS NOT NULL THEN coalesce(quarter_hours, 0)
              ELSE coalesce(csv_ist, 0) END AS DOUBLE) AS ist_d
  FROM fx0
),
frows AS (
  SELECT staff_name, block_name, block_start, block_end, proj_norm, ms_norm, is_special, hours,
         CASE WHEN soll_d > 0 THEN round(soll_d, 2) END AS soll,
         CASE WHEN ist_d > 0 THEN round(ist_d, 2) END AS ist,
         CASE WHEN soll_d > 0 THEN round(ist_d / soll_d * 100.0, 2) END AS pct,
         (CASE WHEN soll_d > 0 THEN ist_d / soll_d * 100.0 ELSE 0.0 END) <= 100.0 AS eligible, billing, adj_h
  FROM fx1
),
ftot AS (
  SELECT *, CAST(bonus_base + adj_regular AS DECIMAL(18,2)) AS bonus_total,
         CAST(special_base + adj_special AS DECIMAL(18,2)) AS special_total
  FROM (
  SELECT staff_name, block_name, block_start, block_end, CAST(sum(hours) AS DECIMAL(18,2)) AS total_hours,
         CAST(coalesce(sum(CASE WHEN eligible AND NOT is_special THEN hours END), 0) AS DECIMAL(18,2)) AS bonus_base,
         CAST(coalesce(sum(CASE WHEN eligible AND is_special THEN hours END), 0) AS DECIMAL(18,2)) AS special_base,
         CAST(coalesce(sum(CASE WHEN NOT is_special THEN adj_h END), 0) AS DECIMAL(18,2)) AS adj_regular,
         CAST(coalesce(sum(CASE WHEN is_special THEN adj_h END), 0) AS DECIMAL(18,2)) AS adj_special
  FROM frows GROUP BY staff_name, block_name, block_start, block_end)
)"""


_MONTH_BLOCK = (f"{month_label_sql('e.month')} AS block_name, e.month AS block_start, last_day(e.month) AS block_end")
_PERIOD_BLOCK = (f"'01.07.1998 - 31.12.1998' AS block_name, {FLEX_START} AS block_start, {FLEX_END} AS block_end")
_WEEK_JOIN = f"""JOIN (SELECT isoyear(booked_on) AS iso_year, weekofyear(booked_on) AS iso_week,
                         min(booked_on) AS wk_start, max(booked_on) AS wk_end
                  FROM entries WHERE booked_on BETWEEN {FLEX_START} AND {FLEX_END} GROUP BY 1, 2) w
        ON w.iso_year = isoyear(e.booked_on) AND w.iso_week = weekofyear(e.booked_on)"""
_WEEK_BLOCK = ("'KW ' || CAST(w.iso_week AS VARCHAR) || ' (' || strftime(w.wk_start, '%d.%m') || ' - ' "
               "|| strftime(w.wk_end, '%d.%m.%Y') || ')' AS block_name, w.wk_start AS block_start, w.wk_end AS block_end")

SQL["flex_rows"] = _flex_sql(_MONTH_BLOCK) + "SELECT * FROM frows"
SQL["flex_period_rows"] = _flex_sql(
    _PERIOD_BLOCK, "AND NOT regexp_matches(e.proj_norm, '^0\\.?0+') AND NOT starts_with(lower(trim(e.proj_norm)), '0000')"
) + "SELECT * FROM frows"
SQL["flex_block_totals"] = _flex_sql(_WEEK_BLOCK, join=_WEEK_JOIN) + "SELECT * FROM ftot"
SQL["flex_summary"] = _flex_sql(_MONTH_BLOCK) + """
SELECT block_name, CAST(sum(total_hours) AS DECIMAL(18,2)) AS total_hours,
       CAST(sum(bonus_base) AS DECIMAL(18,2)) AS bonus_base, CAST(sum(special_base) AS DECIMAL(18,2)) AS special_base,
       CAST(sum(adj_regular) AS DECIMAL(18,2)) AS adj_regular, CAST(sum(adj_special) AS DECIMAL(18,2)) AS adj_special,
       CAST(sum(bonus_total) AS DECIMAL(18,2)) AS bonus_total, CAST(sum(special_total) AS DECIMAL(18,2)) AS special_total
FROM ftot GROUP BY ROLLUP (block_name)"""


# ------------------------------------------------------------ scalar functions

SQL["de_number_parse"] = f"""
WITH t AS (
  SELECT l_orderkey, l_linenumber,
         CASE WHEN l_linenumber = 7 THEN 'x' || CAST(l_orderkey AS VARCHAR)
              WHEN l_linenumber = 6 THEN CAST(l_orderkey AS VARCHAR) || ',125'
              WHEN l_linenumber = 5 THEN '99999999999999999999999' || CAST(l_orderkey AS VARCHAR)
              ELSE translate(format('{{:,.2f}}', CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE)), ',.', '.,') END AS text
  FROM lineitem)
SELECT l_orderkey, l_linenumber, text, TRY_CAST({de_sql('text')} AS DECIMAL(18,2)) AS value FROM t"""

SQL["xml_entries"] = """
WITH t AS (
  SELECT s.s_name AS staff_name, CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) AS DATE) AS quarter,
         CASE WHEN l_linenumber = 1 THEN CAST(0.3333333 AS DECIMAL(30,8)) WHEN l_linenumber = 2 THEN CAST(0.125 AS DECIMAL(30,8))
              WHEN l_linenumber = 3 THEN CAST(0 AS DECIMAL(30,8))
              WHEN l_linenumber = 7 AND l_orderkey % 100 = 0 THEN CAST('100000000000000000000' AS DECIMAL(30,8))
              WHEN l_linenumber = 6 THEN CAST(1 AS DECIMAL(30,8))
              ELSE CAST(CAST(l_quantity * 0.25 AS DECIMAL(18,2)) AS DECIMAL(30,8)) END AS hours,
         CASE l_linenumber WHEN 4 THEN 'a <row> & </row> b' WHEN 5 THEN 'x – y ' || chr(173) ELSE '<plain>' END AS purpose
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey)
SELECT staff_name, quarter, '1234.01 Beispiel' AS proj_norm, '1.1 Paket' AS ms_norm,
       TRY_CAST(sum(hours) AS DECIMAL(18,2)) AS hours, count(*) AS n_entries, min(purpose) AS first_purpose,
       max(purpose) AS last_purpose
FROM t GROUP BY staff_name, quarter"""

_XML_T = SQL["xml_entries"][:SQL["xml_entries"].rindex("SELECT staff_name")]
SQL["xml_documents"] = _XML_T + """,
all_rows AS (
  SELECT * FROM t
  UNION ALL
  SELECT s.s_name, CAST(date_trunc('quarter', CAST(l_shipdate AS DATE)) AS DATE), CAST(0.25 AS DECIMAL(30,8)), 'inner'
  FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE l_linenumber = 2)
SELECT staff_name, quarter, '1234.01 Beispiel' AS proj_norm, '1.1 Paket' AS ms_norm,
       TRY_CAST(sum(hours) AS DECIMAL(18,2)) AS hours, count(*) AS n_entries, min(purpose) AS first_purpose,
       max(purpose) AS last_purpose
FROM all_rows GROUP BY staff_name, quarter"""

SQL["landed_month_hours"] = with_(BOOKINGS.replace(
    "FROM lineitem l JOIN part p", "FROM (SELECT * FROM lineitem WHERE NOT (l_orderkey % 4 = 1 AND l_shipdate >= DATE '2001-01-01')) l JOIN part p")) + """
SELECT staff_name, quarter, month, proj_norm, ms_norm, CAST(sum(hours) AS DECIMAL(18,2)) AS hours
FROM entries GROUP BY staff_name, quarter, month, proj_norm, ms_norm"""
SQL["landed_latest_quarter"] = SQL["latest_quarter"]

SQL["bad_value_account"] = """
WITH t AS (
  SELECT 'times-' || CAST(l_orderkey % 3 AS VARCHAR) AS source_file, l_linenumber AS ln, l_orderkey AS k,
         CAST(l_shipdate AS DATE) AS d, l_orderkey % 17 = 0 AS is_empty FROM lineitem),
r AS (
  SELECT *, NOT is_empty AND k % 11 <> 0 AND k % 7 <> 0 AND k % 13 <> 0 AS valid,
         month(d) IN (3, 5, 10, 12) AS german, CASE WHEN ln = 6 THEN 31 ELSE day(d) END AS dd FROM t)
SELECT source_file, count(*) AS n_rows, count(*) FILTER (valid) AS n_bookings, count(*) FILTER (is_empty) AS no_cells,
       count(*) FILTER (NOT is_empty AND k % 11 = 0) AS no_staff,
       count(*) FILTER (NOT is_empty AND k % 11 <> 0 AND k % 7 = 0) AS no_package,
       count(*) FILTER (NOT is_empty AND k % 11 <> 0 AND k % 7 <> 0 AND k % 13 = 0) AS no_date,
       count(*) FILTER (valid AND dd > day(last_day(make_date(year(d), CASE WHEN german THEN 1 ELSE month(d) END, 1)))) AS date_unread,
       count(*) FILTER (valid AND german) AS month_unknown,
       count(*) FILTER (valid AND (ln = 3 OR ln = 1 AND k % 5 = 0)) AS hours_unread
FROM r GROUP BY source_file"""

SQL["report_requests"] = """
WITH r AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS s, CAST(CAST(o_orderdate AS DATE) + CAST(o_custkey % 120 - 3 AS INTEGER) AS DATE) AS e,
         o_orderkey % 2 = 0 AS quarterly, CASE WHEN o_custkey % 5 <> 0 THEN o_orderstatus || '|' || o_orderpriority ELSE '' END AS items
  FROM orders)
SELECT o_orderkey, items, CASE WHEN s > e THEN 'order' WHEN quarterly AND NOT date_diff('day', s, e) BETWEEN 85 AND 95 THEN 'span' END AS problem,
       CASE WHEN quarterly AND date_trunc('quarter', s) = date_trunc('quarter', e)
            THEN 'Q' || CAST(quarter(s) AS VARCHAR) || '-' || CAST(year(s) AS VARCHAR)
            ELSE 'Report_' || strftime(s, '%Y%m%d') || '-' || strftime(e, '%Y%m%d') END AS name
FROM r"""

SQL["flex_without_bonus"] = _flex_sql(_WEEK_BLOCK, join=_WEEK_JOIN) + """
SELECT staff_name, block_name, block_start, block_end, total_hours FROM ftot"""

SQL["employee_export"] = RULES_ADJ + """,
sheet AS (
  SELECT staff_name, month, 0 AS line, proj_norm, ms_norm, CAST(soll AS DECIMAL(18,2)) AS soll, hours, adj_h FROM ra
  UNION ALL SELECT staff_name, month, 1, NULL, 'Summe', NULL, total_hours, NULL FROM totals2
  UNION ALL SELECT staff_name, month, 2, NULL, 'Bonusberechtigte Stunden', NULL, bonus_total, NULL FROM totals2
  UNION ALL SELECT staff_name, month, 3, NULL, 'Bonusberechtigte Stunden Sonderprojekt', NULL, special_total, NULL FROM totals2)
SELECT staff_name, CAST(row_number() OVER (PARTITION BY staff_name ORDER BY month, line, proj_norm, ms_norm) AS INTEGER) AS place,
       month, proj_norm, ms_norm, soll, hours, CAST(adj_h AS DECIMAL(18,2)) AS adj_h
FROM sheet"""

SQL["overview_table"] = "SELECT CAST(row_number() OVER (ORDER BY lookup_id) AS INTEGER) AS place, lookup_id, project, top_milestone, " \
    f"status, remark, available FROM ({SQL['budget_overview']})"
SQL["cover_table"] = f"SELECT CAST(row_number() OVER (ORDER BY month) AS INTEGER) AS place, * FROM ({SQL['cover_months']})"

# a record with line breaks in a field takes three lines
SQL["budget_csv"] = with_(BUDGET_LINES[:BUDGET_LINES.index("bl1 AS")].rstrip().rstrip(",")) + """
SELECT CAST(sum(CASE WHEN package LIKE '%Position' THEN 3 ELSE 1 END) OVER (ORDER BY row_no)
            - CASE WHEN package LIKE '%Position' THEN 2 ELSE 0 END AS BIGINT) AS line,
       projekte, flag,
       CASE WHEN package LIKE '%Position' THEN package || ' "lang"' || chr(9) || chr(10) || chr(10) || 'Teil' ELSE package END AS package,
       soll_txt, ist_txt, budget_txt, sollhonorar_txt, billed_txt, cost_txt
FROM budget_lines"""

_PREFIXES_SQL = "['• ', '● ', '- ', ' -• ']"

SQL["milestone_norm"] = f"""
WITH r AS (
  SELECT DISTINCT ({_PREFIXES_SQL})[l.l_linenumber % 4 + 1] ||
         (CASE WHEN n <= 2 THEN {_case_type(_SPECIAL)} ELSE {_case_type(B.REGULAR_MILESTONES)} END) AS raw
  FROM lineitem l JOIN (SELECT p_partkey, CAST(substr(p_brand, 7) AS INTEGER) AS n, p_type AS ptype FROM part) p
    ON l.l_partkey = p.p_partkey)
SELECT raw, {norm_ms_sql('raw')} AS ms_norm FROM r"""

SQL["milestone_type"] = with_(BOOKINGS) + """
SELECT DISTINCT ms_norm, CASE WHEN contains(lower(ms_norm), 'quartal') THEN 'quarterly' ELSE 'monthly' END AS milestone_type
FROM entries"""

SQL["budget_from_name"] = with_(BOOKINGS) + f"""
SELECT ms_norm,
       CASE WHEN regexp_extract(ms_norm, '{_BUDGET_RE}', 2) <> ''
            THEN TRY_CAST(replace(regexp_extract(ms_norm, '{_BUDGET_RE}', 1), ',', '.') AS DECIMAL(18,2)) END AS hours,
       CASE WHEN regexp_extract(ms_norm, '{_BUDGET_RE}', 2) <> ''
            THEN lower(regexp_extract(ms_norm, '{_BUDGET_RE}', 2)) END AS unit
FROM (SELECT DISTINCT ms_norm FROM entries)"""


def _billing_sql(pkg: str) -> str:
    low = f"lower({pkg})"
    return (f"CASE WHEN {pkg} IS NULL THEN 'Unbekannt' WHEN contains({low}, '(p)') THEN 'Pauschale' "
            f"WHEN contains({low}, '(an)') OR contains({low}, '(a.n.)') OR contains({low}, '(a n)') THEN 'Nachweis' "
            f"ELSE 'Unbekannt' END")


SQL["billing_type"] = with_(BOOKINGS, BUDGET_LINES) + f"""
SELECT row_no, package, flag,
       CASE WHEN upper(trim(coalesce(flag, ''))) = 'X' THEN {_billing_sql('package')} ELSE 'Unbekannt' END AS billing,
       {_billing_sql('package')} AS billing_forced,
       coalesce(regexp_matches(lower(package), 'nat|nachtrag'), false) AS is_supplement
FROM budget_lines"""

_EN_SQL = "[" + ", ".join(_lit(t) for t in K.ENGLISH_MONTH_TOKENS) + "]"
_DE_SQL = "['Jan', 'Feb', 'Mär', 'Apr', 'Mai', 'Jun', 'Jul', 'Aug', 'Sep', 'Okt', 'Nov', 'Dez']"
_DATE_RE = "(\\d{1,2})\\s+([\\pL\\pN_]{3})\\s+(\\d{4})"
_MONTH_MAP = "MAP {" + ", ".join(f"{_lit(t)}: '{i:02d}'" for i, t in enumerate(K.ENGLISH_MONTH_TOKENS, 1)) + "}"

SQL["date_parse"] = f"""
WITH t AS (
  SELECT l_orderkey, l_linenumber,
         strftime(CAST(l_shipdate AS DATE), '%a') || ', ' ||
         CASE WHEN l_linenumber = 6 THEN '31' ELSE lpad(CAST(day(CAST(l_shipdate AS DATE)) AS VARCHAR), 2, '0') END || ' ' ||
         CASE WHEN l_linenumber = 3 THEN ({_DE_SQL})[month(CAST(l_shipdate AS DATE))]
              ELSE ({_EN_SQL})[month(CAST(l_shipdate AS DATE))] END || ' ' ||
         CAST(year(CAST(l_shipdate AS DATE)) AS VARCHAR) || ' 00:00:00 +0200' AS text
  FROM lineitem),
p AS (
  SELECT *, regexp_extract(text, '{_DATE_RE}', 1) AS d, regexp_extract(text, '{_DATE_RE}', 2) AS m,
         regexp_extract(text, '{_DATE_RE}', 3) AS y
  FROM t)
SELECT l_orderkey, l_linenumber, text,
       CASE WHEN d <> '' THEN CAST(TRY_STRPTIME(y || '-' || coalesce({_MONTH_MAP}[m], '01') || '-' || lpad(d, 2, '0'), '%Y-%m-%d') AS DATE) END AS booked_on,
       (m <> '' AND {_MONTH_MAP}[m] IS NULL) AS month_unknown
FROM p"""

SQL["quarter_parse"] = with_(BOOKINGS) + """
, t AS (
  SELECT unnest([
    'Q' || k || '-' || y, 'Q' || k || '/' || y, 'Q' || k || y, 'Q' || k || ' ' || y,
    y || 'Q' || k, y || '-Q' || k, y || '/Q' || k, y || ' q' || k, 'Q' || CAST(quarter(quarter) + 4 AS VARCHAR) || '-' || y
  ]) AS text
  FROM (SELECT DISTINCT quarter, CAST(year(quarter) AS VARCHAR) AS y, CAST(quarter(quarter) AS VARCHAR) AS k FROM entries)
),
p AS (
  SELECT text, upper(trim(text)) AS s FROM t
),
p2 AS (
  SELECT text,
         CASE WHEN regexp_extract(s, '^Q(\\d)[-/]?\\s*(\\d{4})$', 1) <> '' THEN TRY_CAST(regexp_extract(s, '^Q(\\d)[-/]?\\s*(\\d{4})$', 1) AS INTEGER)
              ELSE TRY_CAST(regexp_extract(s, '^(\\d{4})[-/\\s]*Q(\\d)$', 2) AS INTEGER) END AS q,
         CASE WHEN regexp_extract(s, '^Q(\\d)[-/]?\\s*(\\d{4})$', 1) <> '' THEN TRY_CAST(regexp_extract(s, '^Q(\\d)[-/]?\\s*(\\d{4})$', 2) AS INTEGER)
              ELSE TRY_CAST(regexp_extract(s, '^(\\d{4})[-/\\s]*Q(\\d)$', 1) AS INTEGER) END AS y
  FROM p
)
SELECT text, CASE WHEN q BETWEEN 1 AND 4 THEN make_date(y, q * 3 - 2, 1) END AS quarter FROM p2"""

SQL["project_keys"] = with_(BOOKINGS) + f"""
SELECT proj_norm, CAST(unnest(generate_series(0, len(keys) - 1)) AS INTEGER) AS kpos, unnest(keys) AS project_key
FROM (SELECT proj_norm, {_keys_sql('proj_norm')} AS keys FROM (SELECT DISTINCT proj_norm FROM entries))"""

SQL["status_band"] = with_(BOOKINGS, BUDGET_LINES) + """
SELECT proj_norm, ms_norm, pct,
       CASE WHEN pct < 90 THEN 'green' WHEN pct <= 100 THEN 'yellow' ELSE 'red' END AS status
FROM (SELECT proj_norm, ms_norm,
             round(CASE WHEN soll > 0 THEN CAST(ist AS DOUBLE) / CAST(soll AS DOUBLE) * 100.0
                        WHEN ist > 0 THEN 999.0 ELSE 0.0 END, 2) AS pct FROM plan)"""

SQL["month_label"] = with_(BOOKINGS) + f"""
SELECT month, {month_label_sql('month')} AS month_label FROM (SELECT DISTINCT month FROM entries)"""


_QS = """
qs0 AS (
  SELECT staff_name, quarter, proj_norm, ms_norm,
         CAST(sum(hours) AS DECIMAL(18,2)) AS q_hours0,
         CAST(sum(hours + transferable + from_others) AS DECIMAL(18,2)) AS q_total,
         CAST(sum(coalesce(adj_h, 0)) AS DECIMAL(18,2)) AS q_adj,
         CAST(sum(from_others) AS DECIMAL(18,2)) AS q_from_others
  FROM ra GROUP BY staff_name, quarter, proj_norm, ms_norm
),
qs1 AS (
  SELECT q.*, p.soll AS csv_soll, p.ist AS csv_ist,
         coalesce(starts_with(lower(trim(q.proj_norm)), '0000'), false) AS is_special,
         CASE WHEN regexp_extract(q.ms_norm, '""" + _BUDGET_RE + """', 2) <> ''
              THEN TRY_CAST(replace(regexp_extract(q.ms_norm, '""" + _BUDGET_RE + """', 1), ',', '.') AS DECIMAL(18,2)) END AS nb_h,
         lower(regexp_extract(q.ms_norm, '""" + _BUDGET_RE + """', 2)) AS nb_unit,
         """ + _dict_case('q.ms_norm', K.QUARTERLY_BUDGETS) + """ AS qdict_h,
         """ + _dict_case('q.ms_norm', K.MONTHLY_BUDGETS) + """ AS mdict_h
  FROM qs0 q JOIN plan p ON p.proj_norm = q.proj_norm AND p.ms_norm = q.ms_norm
),
qsum AS (
  SELECT *,
    CAST(CASE WHEN is_special THEN
           CASE WHEN nb_unit = 'quartal' AND nb_h IS NOT NULL THEN nb_h
                WHEN nb_unit = 'monat' AND nb_h IS NOT NULL THEN nb_h * 3
                WHEN qdict_h IS NOT NULL THEN qdict_h
                WHEN mdict_h IS NOT NULL THEN mdict_h * 3 ELSE 0 END
         ELSE coalesce(csv_soll, 0) END AS DECIMAL(18,2)) AS q_soll,
    CAST(CASE WHEN is_special THEN q_hours0 ELSE coalesce(csv_ist, 0) END AS DECIMAL(18,2)) AS q_ist
  FROM qs1
),
qv0 AS (
  SELECT q.*, res.lookup_id, res.billing, res.rate_sv, res.rate_cad, res.rate_adm, res.budget_total,
         coalesce(p.position, 'SV') AS position
  FROM qsum q LEFT JOIN res ON res.proj_norm = q.proj_norm AND res.ms_norm = q.ms_norm
       LEFT JOIN positions p ON p.staff_name = q.staff_name
),
qv1 AS (
  SELECT *,
    CASE WHEN position = '-' THEN 0.0 WHEN lookup_id IS NULL THEN 0.0
         WHEN position = 'CAD' THEN coalesce(rate_cad, 0.0) WHEN position = 'ADM' THEN coalesce(rate_adm, 0.0)
         ELSE coalesce(rate_sv, 0.0) END AS rate,
    CAST(coalesce(budget_total, 0) AS DOUBLE) AS rr, CAST(coalesce(q_soll, 0) AS DOUBLE) AS dd,
    CAST(coalesce(q_ist, 0) AS DOUBLE) AS ee, CAST(q_total + q_from_others AS DOUBLE) AS fk
  FROM qv0
),
qv2 AS (
  SELECT *,
    CASE WHEN position = '-' THEN 0.0
         WHEN billing = 'Pauschale' THEN CASE WHEN rr = 0 OR dd = 0 THEN 0.0
                                              ELSE greatest(0.0, least(rr * (fk / dd), rr - rr * (ee / dd))) END
         ELSE rate * fk END AS revenue,
    CASE WHEN position = '-' THEN 0.0
         WHEN billing = 'Pauschale' THEN CASE WHEN rr = 0 OR dd = 0 THEN 0.0 ELSE rr * (fk / dd) END
         ELSE rate * fk END AS possible
  FROM qv1
)"""

SQL["quarter_revenue"] = _REV + ", " + _QS.strip() + """
SELECT q.staff_name, q.quarter, q.proj_norm, q.ms_norm, q.position, q.billing, round(q.rate, 4) AS rate,
       round(q.revenue, 2) AS revenue, round(q.possible, 2) AS possible, round(q.possible - q.revenue, 2) AS lost,
       round(k.revenue_key, 2) AS revenue_key
FROM qv2 q JOIN (SELECT proj_norm, ms_norm, quarter, sum(revenue) AS revenue_key FROM qv2 GROUP BY 1, 2, 3) k
  ON k.proj_norm = q.proj_norm AND k.ms_norm = q.ms_norm AND k.quarter = q.quarter"""

SQL["quarter_revenue_totals"] = _REV + ", " + _QS.strip() + """
SELECT q.staff_name, q.quarter, round(sum(q.revenue), 2) AS revenue, round(sum(q.possible), 2) AS possible,
       round(sum(q.possible - q.revenue), 2) AS lost, round(sum(k.revenue_key), 2) AS revenue_key
FROM qv2 q JOIN (SELECT proj_norm, ms_norm, quarter, sum(revenue) AS revenue_key FROM qv2 GROUP BY 1, 2, 3) k
  ON k.proj_norm = q.proj_norm AND k.ms_norm = q.ms_norm AND k.quarter = q.quarter
GROUP BY q.staff_name, q.quarter"""

