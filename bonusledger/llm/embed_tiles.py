"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors of unit length are turned onto the principal axes of the whole table, so
leading dimensions carry most of a product.  Equal vectors of a label are one
class; the classes of a label, in the order of their leading coordinate, are cut
into tiles of bounded size.  Two tiles are compared only if their ranges of the
leading coordinate allow a cosine at the threshold.  Within a pair of tiles the
product is accumulated dimension block by dimension block; what is left is bounded
by the product of the suffix norms, and rows and columns without a pair that can
still reach the threshold leave.  Pairs that are left are decided on the original
vectors in double precision.

A pair of tiles gives a count per vector and a spanning forest of its links, never
the pairs themselves.  Vectors that are null, empty, zero or hold null or non-finite
components, and rows without label, link with nothing; nor do vectors of different
lengths (each length is compared by itself).
Rows may repeat: each is a vector of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, land, spanning

TILE = 2048
BLOCKS = (8, 16, 32)  # dimensions after which the bound is tested
EPS = 1e-6


def _floats(col: pa.Array) -> list[np.ndarray]:
    return [np.asarray(x, np.float64) for x in col.to_pylist()]


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Axes (columns) by falling second moment of the unit vectors.  Each task
    sends one dims x dims matrix into a sum by Spark."""

    def moments(batches):
        total = np.zeros((dims, dims))
        for batch in batches:
            if batch.num_rows:
                x = np.stack(_floats(batch.column(0)))
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                total += x.T @ x
        at = np.arange(dims * dims)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel())], ["at", "v"])

    sums = vectors.select("v").mapInArrow(moments, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()
    m = np.zeros(dims * dims)
    for r in sums:
        m[r["at"]] = r["v"]
    _, axes = np.linalg.eigh(m.reshape(dims, dims))
    return axes[:, ::-1].copy()


class _Forest:
    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)

    def links(self) -> list[tuple[int, int]]:
        return [(x, r) for x in self.up if (r := self.root(x)) != x]


def _suffix(x: np.ndarray, at: int) -> np.ndarray:
    return np.sqrt((x[:, at:] ** 2).sum(1))


def close_pairs(a: np.ndarray, b: np.ndarray, axes: np.ndarray, least: float):
    """Row and column places of the pairs with cosine >= least, in double
    precision on the given vectors; yields blocks of them."""
    unit = lambda x: (y := x / np.abs(x).max(1, keepdims=True)) / np.sqrt((y * y).sum(1))[:, None]
    ua, ub = unit(a), unit(b)
    pa_, pb = ua @ axes, ub @ axes
    ra, rb = np.arange(len(a)), np.arange(len(b))
    part, done = np.zeros((len(a), len(b))), 0
    for at in [x for x in BLOCKS if x < a.shape[1]]:
        part += pa_[ra, done:at] @ pb[rb, done:at].T
        done = at
        can = part + np.outer(_suffix(pa_[ra], at), _suffix(pb[rb], at)) >= least - EPS
        rows, cols = can.any(1), can.any(0)
        if not rows.any():
            return
        part = part[np.ix_(rows, cols)]
        ra, rb = ra[rows], rb[cols]
    for at in range(0, len(ra), 512):
        r = ra[at:at + 512]
        i, j = np.nonzero(ua[r] @ ub[rb].T >= least - EPS)
        for k in range(0, len(i), 1 << 16):
            i_, j_ = r[i[k:k + (1 << 16)]], rb[j[k:k + (1 << 16)]]
            x, y = a[i_], b[j_]
            near = np.einsum("ij,ij->i", x, y) / np.sqrt(np.einsum("ij,ij->i", x, x) * np.einsum("ij,ij->i", y, y))
            odd = ~np.isfinite(near)  # lengths whose squares leave the double range
            near[odd] = np.einsum("ij,ij->i", ua[i_][odd], ub[j_][odd])
            ok = near >= least
            yield i_[ok], j_[ok]


def near_vectors(vectors: DataFrame, least: float = 0.93, tile: int = TILE, vec_id: str = "vec_id",
                 vector: str = "embedding", label: str = "label") -> DataFrame:
    """One row per vector: vec_id, n_links and component_id."""
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), v.alias("v"))
    fine = (F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
            & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = land(rows.withColumn("fine", fine).withColumn("key", F.when(F.col("fine"), F.unhex(F.md5(
        F.concat_ws(",", F.transform("v", lambda x: (x + F.lit(0.0)).cast("string"))).cast("binary"))))), "embed")
    # classes of equal vectors; with ids of their own, small numbers for the links
    usable = rows.where("fine").withColumn("dims", F.size("v"))
    classes = land(usable.groupBy("label", "key", "dims").agg(
        F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("cid", F.monotonically_increasing_id()), "embed-classes")
    out = None
    for d in [r["dims"] for r in classes.select("dims").distinct().collect()]:
        got = _compare(classes.where(F.col("dims") == d), d, least, tile)
        out = got if out is None else tuple(x.union(y) for x, y in zip(out, got, strict=True))
    if out is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    counts, links = out
    roots = land(components(links), "embed-roots")
    linked = (classes.select("label", "key", "dims", "cid", "copies", "least")
              .join(counts.groupBy("cid").agg(F.sum("n").alias("n")), "cid", "left")
              .join(roots.withColumnRenamed("node", "cid"), "cid", "left").withColumn("root", F.coalesce("root", "cid")))
    best = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = linked.join(best, "root").select(
        "label", "key", "component_id", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return rows.join(linked, ["label", "key"], "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"))


def _compare(classes: DataFrame, dims: int, least: float, tile: int) -> tuple[DataFrame, DataFrame]:
    """(cid, n): linked vectors of other classes; (a, b): links that span the components."""
    axes = principal_axes(classes, dims)
    lead = axes[:, 0]
    top = sum(F.get("v", F.lit(i)) * float(x) for i, x in enumerate(lead))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    placed = classes.withColumn("p", F.coalesce(F.nanvl(top / norm, F.lit(None)), F.lit(0.0)))
    n = max(1, -(-classes.count() // tile))
    tiled = placed.select("label", "p", "cid", "copies", "v").repartitionByRange(n, "label", "p", "cid").sortWithinPartitions(
        "label", "p", "cid")

    def pack(batches):
        def made():
            a = np.array(vecs)
            return [held, min(ps), max(ps), a.astype("<f8").tobytes(), np.array(cids, "<i8").tobytes(),
                    np.array(copies, "<i8").tobytes()]

        held, ps, cids, copies, vecs, out = None, [], [], [], [], []
        names = ["label", "low", "high", "vecs", "cids", "copies"]
        types = [pa.int64(), pa.float64(), pa.float64(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            for lab, p, cid, c, v in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if cids and (lab != held or len(cids) == tile):
                    out.append(made())
                    ps, cids, copies, vecs = [], [], [], []
                held = lab
                ps.append(p)
                cids.append(cid)
                copies.append(c)
                vecs.append(v)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), types, strict=True)], names)
                out = []
        if cids:
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(made(), types, strict=True)], names)

    tiles = tiled.mapInArrow(
        pack, "label long, low double, high double, vecs binary, cids binary, copies binary")
    tiles = land(tiles.withColumn("t", F.monotonically_increasing_id()), "embed-tiles")
    # unit vectors with a cosine c are sqrt(2 - 2c) apart, and so are their leading coordinates at most
    reach = float(np.sqrt(2 - 2 * least)) + EPS
    ends = tiles.select("label", "t", "low", "high")
    x, y = ends.toDF("label", "t", "low", "high"), ends.toDF("label", "t2", "low2", "high2")
    pairs = x.join(y, "label").where(f"t <= t2 and low2 <= high + {reach} and low <= high2 + {reach}").select("t", "t2")
    work = pairs.join(tiles.select("t", "vecs", "cids", "copies"), "t").join(
        tiles.select(F.col("t").alias("t2"), F.col("vecs").alias("vecs2"), F.col("cids").alias("cids2"),
                     F.col("copies").alias("copies2")), "t2").select(
        (F.col("t") == F.col("t2")).alias("own"), "vecs", "cids", "copies", "vecs2", "cids2", "copies2")

    def compare(batches):
        for batch in batches:
            for own, va, ca, na, vb, cb, nb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = (np.frombuffer(z, "<f8").reshape(-1, dims) for z in (va, vb))
                ca, cb, na, nb = (np.frombuffer(z, "<i8") for z in (ca, cb, na, nb))
                n1, n2, forest = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64), _Forest()
                for i, j in close_pairs(a, b, axes, least):
                    if own:
                        i, j = i[i != j], j[i != j]
                    n1 += np.bincount(i, nb[j], len(a)).astype(np.int64)
                    if not own:
                        n2 += np.bincount(j, na[i], len(b)).astype(np.int64)
                    for p, q in spanning(ca, cb, i, j):
                        forest.join(p, q)
                got = [(int(c), int(n), None) for cs, ns in ((ca, n1), (cb, n2)) for c, n in zip(cs, ns, strict=True) if n]
                got += [(p, None, q) for p, q in forest.links()]
                if got:
                    cols = list(zip(*got, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["cid", "n", "b"])

    found = land(work.repartition(F.col("cids"), F.col("cids2")).mapInArrow(compare, "cid long, n long, b long"), "embed-found")
    return found.where("n is not null").select("cid", "n"), found.where("b is not null").select(F.col("cid").alias("a"), "b")


def op2_pca_tiles(spark, sf_dir: str) -> DataFrame:
    """Links at cosine 0.93 between all embeddings of equal label."""
    got = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return got.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
