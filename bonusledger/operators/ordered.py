"""Order-dependent scans over a file (fill-down, running sums) without one window
over the whole file.

A file's rows are cut into chunks of ``CHUNK`` consecutive order values.  Each
chunk is scanned by its own window partition; what a chunk needs from earlier
chunks (the last non-null value, the sum so far) is a one-row-per-chunk table.
That table is scanned in the same way, chunks of chunks, until a file has no more
than CHUNK entries at the top; the results are joined back level by level.
Partitions therefore never exceed CHUNK rows at any level, whatever the file size.
``scan`` computes any number of fills and sums in one such pass, so a chain of
scans does not multiply the plan.  ``running_total`` does the same over the rows of
a whole table (files, say) in the order of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

CHUNK = 1 << 16


def depth_of(last: int | None, chunk: int = CHUNK) -> int:
    """Levels of carry tables for order values from 0 to ``last``."""
    levels, n = 1, (last or 0) // chunk
    while n >= chunk:
        levels, n = levels + 1, n // chunk
    return levels


def depth(df: DataFrame, order: str = "row_no", chunk: int = CHUNK) -> int:
    """The levels a table needs (a job over one column)."""
    return depth_of(df.agg(F.max(order)).first()[0], chunk)


def scan(df: DataFrame, fills: dict[str, Column] | None = None, prior_fills: dict[str, Column] | None = None,
         sums: dict[str, Column] | None = None, part: str = "file_path", order: str = "row_no",
         chunk: int = CHUNK, levels: int | None = None) -> DataFrame:
    """One ordered pass.  ``levels`` is the depth of the carry tables, if known.

    fills:       out = last non-null value at rows <= current
    prior_fills: out = last non-null value at rows <  current
    sums:        out = running sum of value at rows <= current (nulls count 0)
    """
    fills, prior_fills, sums = fills or {}, prior_fills or {}, sums or {}
    levels = depth(df, order, chunk) if levels is None else levels
    d = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)).cast("long"))
    vals = {f"_v_{k}": v for k, v in {**fills, **prior_fills}.items()}
    vals.update({f"_s_{k}": F.coalesce(v, F.lit(0)) for k, v in sums.items()})
    d = d.withColumns(vals)

    w_in = Window.partitionBy(part, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w_ex = Window.partitionBy(part, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    local = {}
    for k in fills:
        local[f"_l_{k}"] = F.last(f"_v_{k}", ignorenulls=True).over(w_in)
    for k in prior_fills:
        local[f"_l_{k}"] = F.last(f"_v_{k}", ignorenulls=True).over(w_ex)
    for k in sums:
        local[f"_l_{k}"] = F.sum(f"_s_{k}").over(w_in)
    d = d.withColumns(local)

    # one row per chunk: its last non-null value of each fill, its total of each sum
    aggs = [F.max_by(F.col(f"_v_{k}"), F.when(F.col(f"_v_{k}").isNotNull(), F.col(order))).alias(f"_c_{k}")
            for k in {**fills, **prior_fills}]
    aggs += [F.sum(f"_s_{k}").alias(f"_c_{k}") for k in sums]
    per_chunk = d.groupBy(part, "_chunk").agg(*aggs)
    if levels > 1:
        upper = scan(per_chunk.withColumnRenamed("_chunk", "_at"), prior_fills={f"o_{k}": F.col(f"_c_{k}") for k in {**fills, **prior_fills}},
                     sums={f"o_{k}": F.col(f"_c_{k}") for k in sums}, part=part, order="_at", chunk=chunk, levels=levels - 1)
        carry = upper.select(part, F.col("_at").alias("_chunk"), *[F.col(f"o_{k}").alias(f"_k_{k}") for k in {**fills, **prior_fills}],
                             *[(F.col(f"o_{k}") - F.col(f"_c_{k}")).alias(f"_k_{k}") for k in sums])
    else:
        wc = Window.partitionBy(part).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        carry_cols = [F.last(f"_c_{k}", ignorenulls=True).over(wc).alias(f"_k_{k}") for k in {**fills, **prior_fills}]
        carry_cols += [F.coalesce(F.sum(f"_c_{k}").over(wc), F.lit(0)).alias(f"_k_{k}") for k in sums]
        carry = per_chunk.select(part, "_chunk", *carry_cols)

    d = d.join(carry, [part, "_chunk"])
    outs = {k: F.coalesce(F.col(f"_l_{k}"), F.col(f"_k_{k}")) for k in {**fills, **prior_fills}}
    outs.update({k: F.col(f"_l_{k}") + F.col(f"_k_{k}") for k in sums})
    d = d.withColumns(outs)
    return d.drop("_chunk", *[c for c in d.columns if c[:3] in ("_v_", "_s_", "_l_", "_k_")])


def running_sum(df: DataFrame, value: Column, out: str, part: str = "file_path", order: str = "row_no",
                chunk: int = CHUNK, levels: int | None = None) -> DataFrame:
    return scan(df, sums={out: value}, part=part, order=order, chunk=chunk, levels=levels)


def running_total(df: DataFrame, key: str, value: Column, out: str, chunk: int = CHUNK) -> DataFrame:
    """(key, out): the sum of ``value`` over all rows up to a key, for a table with
    one row per key.  Rows are dealt by ranges of the key, about a chunk each; a task
    sums its own range, and the sums of the tasks before it come from a scan."""
    rows = materialize(df.select(F.col(key), value.alias("_value")), "totals")
    tasks = max(1, -(-rows.count() // chunk))
    if tasks == 1:
        whole = Window.orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(key, F.sum("_value").over(whole).alias(out))
    rows = materialize(rows.repartitionByRange(tasks, key).withColumn("_task", F.spark_partition_id().cast("long")), "totals")
    upper = scan(rows.groupBy("_task").agg(F.sum("_value").alias("_sum")).withColumn("_all", F.lit(0)), sums={"_upto": F.col("_sum")},
                 part="_all", order="_task", chunk=chunk, levels=depth_of(tasks, chunk))
    inside = Window.partitionBy("_task").orderBy(key).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_inside", F.sum("_value").over(inside)).join(upper, "_task").select(
        key, (F.col("_inside") + F.col("_upto") - F.col("_sum")).alias(out))


def block_scan(df: DataFrame, part: str, block: str, order: str, sums: dict[str, Column], lags: dict[str, Column]) -> DataFrame:
    """One ordered pass over rows that lie in blocks (a file's splits), in the order
    (``block``, ``order``): running sums up to and with the current row, and values
    of the row before.  A window holds one block; what a block needs from earlier
    ones comes from a table of one row per block."""
    values = {f"_s_{k}": v for k, v in sums.items()} | {f"_v_{k}": v for k, v in lags.items()}
    d = df.withColumns(values)
    inside = Window.partitionBy(part, block).orderBy(order)
    d = d.withColumns({f"_l_{k}": F.sum(f"_s_{k}").over(inside.rowsBetween(Window.unboundedPreceding, 0)) for k in sums}
                      | {f"_l_{k}": F.lag(f"_v_{k}").over(inside) for k in lags})
    per_block = d.groupBy(part, block).agg(*[F.sum(f"_s_{k}").alias(f"_c_{k}") for k in sums],
                                           *[F.max_by(f"_v_{k}", order).alias(f"_c_{k}") for k in lags], F.min(order).alias("_first"))
    over = Window.partitionBy(part).orderBy(block)
    carry = per_block.select(
        part, block, "_first", *[(F.sum(f"_c_{k}").over(over) - F.col(f"_c_{k}")).alias(f"_k_{k}") for k in sums],
        *[F.lag(f"_c_{k}").over(over).alias(f"_k_{k}") for k in lags])
    d = d.join(carry, [part, block])
    first = F.col(order) == F.col("_first")
    d = d.withColumns({k: F.col(f"_l_{k}") + F.col(f"_k_{k}") for k in sums}
                      | {k: F.when(first, F.col(f"_k_{k}")).otherwise(F.col(f"_l_{k}")) for k in lags})
    return d.drop("_first", *[c for c in d.columns if c[:3] in ("_v_", "_s_", "_l_", "_k_")])
