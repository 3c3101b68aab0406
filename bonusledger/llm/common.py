"""Shared pieces of the operators in this subpackage: landed tables, and connected components on Spark."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import run_folder


def land(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Writes ``df`` to the application's folder below ``spark.checkpoint.dir`` and reads
    it back: the lineage is cut on reliable storage and its exact size is known to the
    optimiser.  ``session.cleanup`` removes it."""
    spark = df.sparkSession
    path = f"{run_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(batches, rows: int = 500):
    """Arrow batches cut into parts of ``rows`` rows, so that a task holds the
    Python objects of few texts at once."""
    for batch in batches:
        for at in range(0, max(1, batch.num_rows), rows):
            yield batch.slice(at, rows)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected long-valued ``edges``: one row (node,
    root) per node that has a link to another node, root being the smallest node
    of its component.  Alternating large-star and small-star rounds until every
    node hangs on one root; each is joins and partial minima, so a hub's links may
    be split over tasks, and each round is landed."""
    e = land(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct(), "cc")
    while not _is_stars(e):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        e = land(small.union(low.select("u", "m")).distinct(), "cc")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select("v", F.col("v").alias("root")).distinct())


def _is_stars(e: DataFrame) -> bool:
    """Whether each node of the edges (u, v) is a root or hangs on one root."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(e.select("v", F.lit(0)))
    node = ends.groupBy("x").agg(F.sum("up").alias("up"), F.min("up").alias("least"))
    return node.where("up > 1 or up = 1 and least = 0").agg(F.count("*")).first()[0] == 0


def spanning(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> set[tuple[int, int]]:
    """Links that join what the pairs (a[i], b[j]) join, at
    most one per place: the least name travels along the pairs until it stays."""
    la, lb = a.copy(), b.copy()
    while True:
        m = np.minimum(la[i], lb[j])
        if (m == la[i]).all() and (m == lb[j]).all():
            return set(zip(a[i].tolist(), m.tolist(), strict=True)) | set(zip(b[j].tolist(), m.tolist(), strict=True))
        np.minimum.at(la, i, m)
        np.minimum.at(lb, j, m)
