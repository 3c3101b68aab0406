import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from bonusledger.session import local_session  # noqa: E402

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    s = local_session(shuffle_partitions=8)
    yield s


def entries_df(spark, rows):
    """rows: (staff, project, package, 'YYYY-MM-DD', hours)"""
    from datetime import date
    from decimal import Decimal

    from bonusledger.sources.bridge import with_entry_keys

    data = [(s, p, w, date.fromisoformat(d), Decimal(str(h)), "t") for s, p, w, d, h in rows]
    df = spark.createDataFrame(
        data, "staff_name string, project string, work_package_name string, booked_on date, "
              "hours decimal(18,2), source_file string")
    return with_entry_keys(df)


def lines_df(spark, rows, file_path="mem/budget.csv"):
    """rows: (projekte, flag, package, soll_txt, ist_txt, budget_txt, sollhonorar_txt); row_no = index."""
    full = []
    for i, r in enumerate(rows):
        r = list(r) + [None] * (7 - len(r))
        full.append((file_path, i, r[0], r[1], r[2], r[3], r[4], r[5], r[6], None, None))
    return spark.createDataFrame(
        full, "file_path string, row_no long, projekte string, flag string, package string, soll_txt string, "
              "ist_txt string, budget_txt string, sollhonorar_txt string, billed_txt string, cost_txt string")
