"""Sharding by a hierarchical weighted hash tree.

A row descends region, rack and shard levels.  At each level every child makes a
hash draw -ln(u) / weight from the row's key; the smallest wins, so a child gets
its share of the weight.  Weight that is added later is a layer of its own: its
draws stand beside those of the earlier layers, and a row that is won by a layer
descends only through that layer's weights.  So a grown tree moves rows only
along the path whose weights changed, and only into the added shard.

JVM expressions only.  A null key is a key like any other (all such rows share a
shard); repeated keys share a shard; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land

# (region, rack, shard, weight)
Leaf = tuple[str, str, int, float]


@dataclass(frozen=True)
class Tree:
    """Layers of leaves, oldest first.  ``even`` builds the usual first layer."""

    layers: tuple[tuple[Leaf, ...], ...]

    @staticmethod
    def even(shards: int, regions: int = 2, racks: int = 3) -> Tree:
        at = lambda s: (f"r{s * regions // shards}", f"k{s * regions * racks // shards}")
        return Tree((tuple((*at(s), s, 1.0) for s in range(shards)),))

    def grown(self, *leaves: Leaf) -> Tree:
        return Tree((*self.layers, tuple(leaves)))

    def children(self, path: tuple) -> list[tuple[object, float]]:
        """(name, weight) below a node; the root's children are (layer, region)."""
        out: dict = {}
        for n, layer in enumerate(self.layers):
            for leaf in layer:
                full = ((n, leaf[0]), leaf[1], leaf[2])
                if full[: len(path)] == path:
                    out[full[len(path)]] = out.get(full[len(path)], 0.0) + leaf[3]
        return list(out.items())


def _draw(key: Column, path: tuple, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(repr(path))), 11)
    return -F.log((bits.cast("double") + 0.5) / F.lit(2.0**53)) / F.lit(float(weight))


def _pick(key: Column, tree: Tree, path: tuple) -> Column:
    kids = tree.children(path)
    if len(kids) == 1:
        return F.lit(0)
    return F.array_min(F.array(*[
        F.struct(_draw(key, (*path, name), w).alias("d"), F.lit(i).alias("i")) for i, (name, w) in enumerate(kids)
    ]))["i"]


def shard_of(df: DataFrame, key: str, tree: Tree, out: str) -> DataFrame:
    """``df`` with the shard of each row in column ``out``."""
    k, one, two = F.col(key), f"__{out}_region", f"__{out}_rack"
    tops = [name for name, _ in tree.children(())]
    df = df.withColumn(one, _pick(k, tree, ()))
    rack = leaf = None
    for i, top in enumerate(tops):
        rack = (F.when if rack is None else rack.when)(F.col(one) == i, _pick(k, tree, (top,)))
    df = df.withColumn(two, rack)
    for i, top in enumerate(tops):
        for j, (name, _) in enumerate(tree.children((top,))):
            ends = F.array(*[F.lit(int(s)) for s, _ in tree.children((top, name))])
            hit = F.get(ends, _pick(k, tree, (top, name)))
            leaf = (F.when if leaf is None else leaf.when)((F.col(one) == i) & (F.col(two) == j), hit)
    return df.withColumn(out, leaf).drop(one, two)


def with_slots(df: DataFrame, shard: str, *order: str, per_bucket: int = 50_000) -> DataFrame:
    """Adds ``slot``, numbering the rows of each shard from 0 without gaps.  Rows
    are numbered within hash buckets of about ``per_bucket`` rows, and a running
    sum over the small table of bucket counts shifts them, so no window holds a
    whole shard."""
    df = land(df, "shards")
    n = max(1, -(-df.count() // per_bucket))
    df = df.withColumn("__bucket", F.pmod(F.xxhash64(F.lit("slot"), *order), F.lit(n)).cast("int"))
    counts = df.groupBy(shard, "__bucket").agg(F.count("*").alias("__n"))
    shift = counts.selectExpr(
        shard, "__bucket",
        f"sum(__n) over (partition by {shard} order by __bucket) - __n as __shift")
    numbered = df.selectExpr(
        "*", f"row_number() over (partition by {shard}, __bucket order by {', '.join(order)}) - 1 as __at")
    return (numbered.join(shift, [shard, "__bucket"]).withColumn("slot", F.col("__at") + F.col("__shift"))
            .drop("__bucket", "__at", "__shift"))


def op4_hash_tree(spark, sf_dir: str, shards: int = 24) -> DataFrame:
    """Every document in one of ``shards`` shards, and its shard in a tree grown
    by one leaf.  Null text counts no bytes; equal rows get slots of their own."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    tree = Tree.even(shards)
    last = tree.layers[0][-1]
    rows = shard_of(rows, "doc_id", tree, "shard")
    rows = shard_of(rows, "doc_id", tree.grown((last[0], last[1], shards, 1.0)), "grown_shard")
    return with_slots(rows, "shard", "doc_id", "text_crc32", "size").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
