"""Filter lists as tables."""

import random

import pytest

from bonusledger.operators import bookings as BK


def brute(keys, prefixes):
    return sorted(k for k in keys if k.startswith(tuple(prefixes)))


@pytest.mark.parametrize("how", ["list", "table"])
def test_prefix_lists(spark, how):
    r = random.Random(2)
    keys = ["".join(r.choice("01ä.\U0010ffff ") for _ in range(r.randint(0, 9))) for _ in range(800)]
    for prefixes in ([f"{k[:4]}" for k in keys if len(k) > 3][:90], [k + "x" for k in keys[:200]], keys[:60] + [""]):
        df = spark.createDataFrame([(k,) for k in keys], "proj_norm string")
        given = prefixes if how == "list" else spark.createDataFrame([(p,) for p in prefixes + [None]], "p string")
        assert sorted(x[0] for x in BK.projects_matching(df, given).collect()) == brute(keys, prefixes)


def test_many_prefixes_are_a_join_and_a_range(spark, tmp_path):
    prefixes = [f"{n:06d}" for n in range(200_000, 300_000)]
    spark.range(1000).selectExpr("concat(cast(id * 700 as string), '.01 P') as proj_norm", "id").write.parquet(str(tmp_path / "e"))
    df = BK.projects_matching(spark.read.parquet(str(tmp_path / "e")), prefixes)
    plan = df._jdf.queryExecution().toString()
    scan = next(x for x in plan.splitlines() if "PushedFilters" in x)
    assert "LeftSemi" in plan and plan.count(" OR ") == 0 and "GreaterThanOrEqual(proj_norm,200000)" in scan and "LessThan(proj_norm" in scan
    assert sorted(r["id"] for r in df.collect()) == [i for i in range(1000) if 200_000 <= i * 700 < 300_000]


def test_employee_lists(spark):
    names = [f"S{i}" for i in range(500)]
    df = spark.createDataFrame([(n, 1) for n in names], "staff_name string, hours int")
    wanted = names[::3] + ["s3", "other"]
    for given in (wanted, spark.createDataFrame([(n,) for n in wanted + wanted], "n string")):
        assert sorted(r[0] for r in BK.employees_matching(df, given).collect()) == sorted(names[::3])
    assert BK.employees_matching(df, []).count() == 500
