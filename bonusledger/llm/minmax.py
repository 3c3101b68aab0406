"""Near-duplicate documents by min-max hashing.

A document is its set of word shingles.  Each permutation gives two signature
values, the minimum and the maximum over the set, so half as many hashes are
evaluated as values are kept.  Bands of ``rows`` values are hashed into buckets;
their number is set so that a pair at the threshold shares no bucket with a chance
below ``miss``.

Equal sets are one class.  In each bucket every class is compared with the one
that shares buckets with most others, on full sets; components of the links
follow.  Buckets that then still hold several components are compared whole, in
tiles of bounded size, each set as its difference from the head's: products of
incidence matrices give all intersections of two tiles, and a spanning forest of
the links leaves the task.  So every pair of
classes that shares a bucket is either compared or already joined, and no pairs of
a bucket are ever listed.

Null texts and texts without words have an empty set and link with nothing.
Repeated rows belong to one class; a null id counts as larger than any other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, land, small, spanning

ROWS, MISS = 5, 1e-6
_CACHE = 200_000  # words that a worker keeps
TILE = 512  # members of a tile at most, about
COLUMNS = 20_000  # columns of an incidence matrix at once


def bands(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """Bands needed, a number of values that minima and maxima make up evenly."""
    n = math.ceil(math.log(miss) / math.log(1 - threshold**rows))
    return n + n * rows % 2


class _Words(dict):
    def __missing__(self, word):
        if len(self) >= _CACHE:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: bytes | None, k: int, seen: dict) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct k-word shingles."""
    seq = text.lower().split() if text else []
    if not seq:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(seen.__getitem__, seq), np.uint64, len(seq))
    size = min(k, len(w))
    out = np.full(len(w) - size + 1, size, np.uint64)
    for i in range(size):
        out = _mixed(out + w[i:len(w) - size + 1 + i])
    return np.unique(out)


def _signature(x: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Minimum and maximum of each permutation, side by side."""
    low = np.full(len(mult), np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(len(mult), np.uint64)
    for at in range(0, len(x), 1024):
        h = mult[:, None] * x[None, at:at + 1024]
        np.minimum(low, h.min(1), out=low)
        np.maximum(high, h.max(1), out=high)
    return np.concatenate([low, high])


def signatures(docs: DataFrame, doc_id: str, text: str, k: int, threshold: float) -> DataFrame:
    """One row per document: id, hash of the text, set size, 128-bit key of the
    set, and a bucket per band."""
    n_bands = bands(threshold)
    rng = np.random.default_rng(20)
    mult = rng.integers(1 << 62, 1 << 63, n_bands * ROWS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    order = rng.permutation(n_bands * ROWS)
    salt = rng.integers(0, 1 << 63, n_bands, dtype=np.uint64)
    names = ["doc_id", "md5", "n", "k1", "k2", "buckets"]

    def run(batches):
        seen = _Words()
        for batch in small(batches):
            rows = []
            for t in batch.column(2).to_pylist():
                x = shingles(t, k, seen)
                if not len(x):
                    rows.append((0, 0, 0, []))
                    continue
                v = _signature(x, mult)[order].reshape(n_bands, ROWS)
                h = salt.copy()
                for j in range(ROWS):
                    h = _mixed(h + v[:, j])
                key = xxhash.xxh3_128_intdigest(x.tobytes())
                rows.append((len(x), (key >> 64) - (1 << 63), (key & ((1 << 64) - 1)) - (1 << 63), h.view(np.int64)))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in cols[:3]),
                pa.array([list(c) for c in cols[3]], pa.list_(pa.int64()))], names)

    body = F.col(text).cast("binary")
    return docs.select(F.col(doc_id).cast("long"), F.unhex(F.md5(F.coalesce(body, F.lit(b"")))), body).mapInArrow(
        run, "doc_id long, md5 binary, n long, k1 long, k2 long, buckets array<long>")


def _compared(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """Pairs (head, cid) on full sets: whether they are similar enough, the size of
    the head's set, and the other set as its difference from it (the shingles that
    only one has, and how many of them are the head's)."""
    percent = round(threshold * 100)
    both = (pairs.join(texts.selectExpr("cid as head", "text as th"), "head")
            .join(texts.selectExpr("cid", "text as tc"), "cid"))
    names = ["head", "cid", "linked", "full", "gone", "delta"]

    def run(batches):
        seen, sets = _Words(), {}

        def of(cid, t):
            if cid not in sets:
                if len(sets) >= 200:
                    sets.clear()
                sets[cid] = shingles(t, k, seen)
            return sets[cid]

        for batch in small(batches):
            linked, full, gone, delta = [], [], [], []
            for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = of(a, ta), of(b, tb)
                d = np.setxor1d(x, y, assume_unique=True)
                same = (len(x) + len(y) - len(d)) // 2
                linked.append(100 * same >= percent * (len(d) + same))
                full.append(len(x))
                gone.append(len(x) - same)
                delta.append(d.view(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), pa.array(linked, pa.bool_()), pa.array(full, pa.int64()),
                pa.array(gone, pa.int64()), pa.array(delta, pa.list_(pa.int64()))], names)

    return both.select("head", "cid", F.col("th").cast("binary"), F.col("tc").cast("binary")).mapInArrow(
        run, "head long, cid long, linked boolean, full long, gone long, delta array<long>")


def _tile_links(a: list, b: list, percent: int) -> set[tuple[int, int]]:
    """Links that join what the similar pairs of two tiles join.  A member is a
    dict of cid, root, n, full, gone and delta; members of one root are joined
    already.  With differences from one head's set of ``full`` shingles, two sets
    share full - gone - gone' + |delta and delta'|."""
    members = [*a, *b]
    sizes, gone, roots, cids = (np.array([m[c] for m in members], np.int64) for c in ("n", "gone", "root", "cid"))
    deltas = [np.array(m["delta"], np.int64) for m in members]
    _, place, seen = np.unique(np.concatenate(deltas), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(members)), [len(x) for x in deltas])
    shared = seen[place] > 1
    row, col = row[shared], np.unique(place[shared], return_inverse=True)[1]
    n = len(a)
    both = (members[0]["full"] - gone[:n, None] - gone[n:]).astype(np.float32)
    for at in range(0, int(col.max(initial=-1)) + 1, COLUMNS):
        here = (col >= at) & (col < at + COLUMNS)
        m = np.zeros((len(members), int(min(COLUMNS, col.max() + 1 - at))), np.float32)
        m[row[here], col[here] - at] = 1
        both += m[:n] @ m[n:].T
    both = both.astype(np.int64)  # sums of counts below 2 to the 24 are exact
    apart = roots[:n, None] != roots[n:]
    i, j = np.nonzero(apart & (100 * both >= percent * (sizes[:n, None] + sizes[n:] - both)))
    return spanning(cids[:n], cids[n:], i, j)


def _rest(rooted: DataFrame, compared: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of a bucket with different roots."""
    percent = round(threshold * 100)
    split = rooted.groupBy("bucket").agg(
        F.min("root").alias("r0"), F.max("root").alias("r1"), F.ceil(F.count("*") / TILE).alias("tiles")).where("r0 != r1")
    rest = rooted.join(split.select("bucket", "tiles"), "bucket")
    tile = F.pmod(F.xxhash64("cid", F.lit(7)), F.col("tiles")).alias("tile")
    own = F.col("cid") == F.col("head")
    member = F.struct("cid", "root", "n", F.when(own, F.col("n")).otherwise(F.col("full")).alias("full"),
                      F.coalesce("gone", F.lit(0)).alias("gone"),
                      F.coalesce("delta", F.array().cast("array<long>")).alias("delta"))
    tiles = land(
        rest.join(compared.select("head", "cid", "full", "gone", "delta"), ["head", "cid"], "left")
        .select("bucket", "tiles", tile, member.alias("member")).groupBy("bucket", "tile").agg(
            F.first("tiles").alias("tiles"), F.collect_list("member").alias("members")), "minmax-tiles")
    one = tiles.select("bucket", F.col("tile").alias("t1"), F.explode(F.sequence("tile", F.col("tiles") - 1)).alias("t2"), "members")
    two = tiles.select("bucket", F.col("tile").alias("t2"), F.col("members").alias("members2"))

    def compare(batches):
        for batch in small(batches):
            links: set = set()
            for i in range(batch.num_rows):
                links |= _tile_links(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), percent)
            links = {(x, y) for x, y in links if x != y}
            cols = list(zip(*links, strict=True)) or [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return one.join(two, ["bucket", "t2"]).select("members", "members2").mapInArrow(compare, "a long, b long")


def near_copies(docs: DataFrame, k: int = 5, threshold: float = 0.8, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One row per document: doc_id, md5 of its text, n (set size), cid (its class;
    null without words) and the component's smallest document as first_id,
    first_md5 (its own without words)."""
    sigs = land(signatures(docs, doc_id, text, k, threshold), "minmax")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "md5"))
    classes = land(
        sigs.where("n > 0").groupBy("k1", "k2", "n").agg(least.alias("first"), F.first("buckets").alias("buckets"))
        .withColumn("cid", F.monotonically_increasing_id()), "minmax-classes")
    members = classes.select("cid", "n", F.explode("buckets").alias("bucket"))
    full = members.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    inside = land(members.join(full, "bucket"), "minmax-buckets")
    score = inside.groupBy("cid").agg(F.sum("m").alias("score"))
    heads = inside.join(score, "cid").groupBy("bucket").agg(F.max(F.struct("score", "cid"))["cid"].alias("head"))
    inside = inside.join(heads, "bucket").select("bucket", "cid", "n", "head")
    inside = land(inside, "minmax-heads")
    wanted = inside.select("cid").distinct().join(classes.select("cid", "first"), "cid").select(
        "cid", F.col("first.doc_id").alias("id"), F.col("first.md5").alias("md5"))
    body = F.coalesce(F.col(text), F.lit(""))
    source = docs.select(F.col(doc_id).cast("long").alias("id"), F.unhex(F.md5(body)).alias("md5"), body.alias("text"))
    texts = land(
        source.join(wanted, (source["id"].eqNullSafe(wanted["id"])) & (source["md5"] == wanted["md5"]))
        .select("cid", "text").dropDuplicates(["cid"]), "minmax-texts")
    pairs = inside.where("cid != head").select("head", "cid").distinct()
    compared = land(_compared(pairs, texts, k, threshold), "minmax-compared")
    links = compared.where("linked").select(F.col("head").alias("a"), F.col("cid").alias("b"))
    roots = land(components(links), "minmax-roots")

    rooted = inside.join(roots, F.col("cid") == F.col("node"), "left").select(
        "bucket", "cid", "n", "head", F.coalesce("root", "cid").alias("root"))
    more = land(_rest(land(rooted, "minmax-rooted"), compared, threshold), "minmax-links")
    if not more.isEmpty():
        roots = land(components(roots.selectExpr("node as a", "root as b").union(more)), "minmax-roots")

    own = classes.join(roots, F.col("cid") == F.col("node"), "left").select(
        "cid", "k1", "k2", "first", F.coalesce("root", "cid").alias("root"))
    best = own.groupBy("root").agg(F.min("first").alias("best"))
    of_class = own.join(best, "root").select("cid", "k1", "k2", "best")
    found = sigs.join(of_class, ["k1", "k2"], "left")
    return found.select(
        "doc_id", "md5", "n", F.when(F.col("n") > 0, F.col("cid")).alias("cid"),
        F.when(F.col("n") > 0, F.col("best.doc_id")).otherwise(F.col("doc_id")).alias("first_id"),
        F.when(F.col("n") > 0, F.col("best.md5")).otherwise(F.col("md5")).alias("first_md5"))


def keep_one(docs: DataFrame, k: int = 5, threshold: float = 0.8) -> DataFrame:
    """One document of each group of near copies, columns as given: the one with
    the smallest id (of rows with the same id and text, one).  Documents without
    words stay."""
    found = land(near_copies(docs, k, threshold), "minmax-found")
    gone = found.where("n > 0 and not (doc_id <=> first_id and md5 = first_md5)").select("doc_id", "md5").distinct()
    gone = land(gone, "minmax-gone").selectExpr("doc_id as __id", "md5 as __md5")
    body = F.coalesce(F.col("text"), F.lit(""))
    kept = docs.withColumn("__h", F.unhex(F.md5(body))).join(
        gone, F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__md5")), "left_anti").drop("__h")
    twice = found.where("n > 0").groupBy("doc_id", "md5").count().where("count > 1")
    if twice.isEmpty():
        return kept
    words = F.length(F.regexp_replace(body, r"[\x20\x09-\x0D]+", "")) > 0
    return kept.where(words).dropDuplicates(["doc_id", "text"]).union(kept.where(~words))


def op10_min_max(spark, sf_dir: str) -> DataFrame:
    """Components of documents whose 3-word shingle sets are 0.85 alike."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_copies(docs, 3, 0.85).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("first_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("first_id")).alias("kept"))
