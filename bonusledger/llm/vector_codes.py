"""Product codes of vectors, nearest entries found by a GNAT over each codebook.

Components become integers, floor(1024 x), and a vector is cut into equal parts.
Each part position has a codebook of at most 256 integer entries, refined by a few
rounds of assignment and componentwise floored means.  An assignment looks for the
nearest entry in a geometric near-neighbour access tree: a node holds split points
and, for every split point and every child, the range of their distances; with the
distances from a query to the split points, a child is left out where no distance
of its range can be as near as the best entry so far.  Distances and bounds are
rounded outwards and compared strictly, so an entry that ties is always reached;
which of equal ones wins (the lower index) is decided on integer squared distances.

A round reads the vectors once; tasks send one partial sum per part and entry, and
these are added up on Spark.  Codebooks are all that passes the driver: entries x
dimension integers, whatever the number of rows.

Rows whose vector is null or holds null or non-finite components are dropped.  Other
rows all have a code: shorter vectors stand as if filled up with zeros to the longest
length, rounded up to a multiple of the number of parts.  Null and repeated ids are
rows of their own; the first codebook takes rows by id (nulls last), then by vector.
An error beyond a long's range is null.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land, table

_SCALE, _EXACT = 1024, 2.0**52  # integers below stay exact in doubles
_SPLITS = 16


def integers(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of floor(1024 x), filled up with zeros: doubles that hold integers
    while squared distances stay exact in them, else Python integers."""
    lengths = np.asarray(vectors.value_lengths())
    out = np.zeros((len(vectors), dim))
    out[np.arange(dim)[None, :] < lengths[:, None]] = np.asarray(vectors.flatten().cast(pa.float64()))
    if not out.size or np.abs(out).max() <= isqrt(int(_EXACT) // max(1, dim)) // 2 / _SCALE - 1:
        return np.floor(out * _SCALE)
    exact = np.zeros(out.shape, object)
    for i, row in enumerate(out):
        for j, x in enumerate(row.tolist()):
            top, bottom = x.as_integer_ratio()
            exact[i, j] = top * _SCALE // bottom
    return exact


def narrow(a: np.ndarray) -> np.ndarray:
    """Doubles where they hold squared distances of ``a`` exactly."""
    limit = isqrt(int(_EXACT) // max(1, a.shape[-1] if a.ndim else 1)) // 2
    if a.dtype == object and all(-limit < x < limit for x in a.ravel()):
        return a.astype(np.float64)
    return a


def squares(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row of ``q`` to every row of ``c``."""
    if q.dtype == object or c.dtype == object:
        q, c = (x if x.dtype == object else _whole(x) for x in (q, c))
        return ((q[:, None, :] - c[None, :, :]) ** 2).sum(axis=2, initial=0)
    return (q * q).sum(1)[:, None] + (c * c).sum(1)[None, :] - 2.0 * (q @ c.T)


def _whole(a: np.ndarray) -> np.ndarray:
    return np.array([int(x) for x in a.ravel()], object).reshape(a.shape)


_MARGIN = 1e-12  # relative; far beyond what rounding can move a root or a difference


def _root(d2: np.ndarray, up: bool) -> np.ndarray:
    """Square roots, rounded outwards; of Python integers as integers."""
    if d2.dtype == object:
        return np.array([isqrt(int(x)) + up for x in d2.ravel()], object).reshape(d2.shape)
    return np.sqrt(d2) * (1 + _MARGIN if up else 1 - _MARGIN)


class Node:
    """Split points (places in the codebook, ascending) and, under each, the other
    entries that are nearest to it."""

    def __init__(self, entries: np.ndarray, places: np.ndarray):
        self.places, self.children, self.low, self.high = places, [], None, None
        self.points = entries[places]
        if len(places) <= _SPLITS:
            return
        mine = entries[places]
        # split points far from each other, the first being the first entry
        chosen, far = [0], squares(mine, mine[:1])[:, 0]
        while len(chosen) < _SPLITS:
            nxt = int(np.argmax(far))
            if far[nxt] == 0:
                break
            chosen.append(nxt)
            far = np.minimum(far, squares(mine, mine[nxt:nxt + 1])[:, 0])
        chosen = np.array(sorted(chosen))
        d2 = squares(mine, mine[chosen])
        home = d2.argmin(axis=1)
        rest = np.ones(len(places), bool)
        rest[chosen] = False
        self.places, self.points = places[chosen], mine[chosen]
        low, high = [], []
        self.child = np.full(len(chosen), -1)  # of a split point
        for j in range(len(chosen)):
            inside = np.flatnonzero(rest & (home == j))
            if len(inside):
                self.child[j] = len(self.children)
                self.children.append(Node(entries, places[inside]))
                low.append(_root(d2[inside].min(axis=0), False))
                high.append(_root(d2[inside].max(axis=0), True))
        if self.children:
            self.low, self.high = np.array(low), np.array(high)

    def search(self, q: np.ndarray, rows: np.ndarray, best: np.ndarray, at: np.ndarray, looked: list[int]) -> None:
        """Makes ``best`` (squared distance) and ``at`` (place) of the given rows of
        ``q`` the least over this node and what ``best`` has already seen."""
        d2 = squares(q[rows], self.points)
        looked[0] += d2.size
        first = d2.argmin(axis=1)  # places ascend, so the first of equal ones is the lowest
        near, place = d2[np.arange(len(rows)), first], self.places[first]
        seen = at[rows] >= 0
        better = ~seen | (near < best[rows]) | ((near == best[rows]) & (place < at[rows]))
        best[rows[better]], at[rows[better]] = near[better], place[better]
        if not self.children:
            return
        inner, outer = _root(d2, False), _root(d2, True)
        # first the child of the nearest split point, which makes the radius small for the others
        near = self.child[first]
        for c, child in enumerate(self.children):
            if (near == c).any():
                child.search(q, rows[near == c], best, at, looked)
        for c, child in enumerate(self.children):
            # how far away the child's entries are at least, by the ranges of all split points
            gap = np.maximum(inner - self.high[c], self.low[c] - outer).max(axis=1)
            left = rows[(gap <= _root(best[rows], True)) & (near != c)]
            if len(left):
                child.search(q, left, best, at, looked)


class Codebook:
    def __init__(self, entries: np.ndarray):
        self.entries = narrow(entries)
        self.root = Node(self.entries, np.arange(len(entries)))
        self.looked = [0]

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, exact squared distance) of the nearest entry of each row."""
        exact = q.dtype == object or self.entries.dtype == object
        best, at = np.zeros(len(q), object if exact else np.float64), np.full(len(q), -1)
        if len(q):
            self.root.search(q, np.arange(len(q)), best, at, self.looked)
        return at, best


def _parts(q: np.ndarray, parts: int) -> list[np.ndarray]:
    return np.split(q, parts, axis=1)


def _texts(a: np.ndarray) -> list[str]:
    return [str(int(x)) for x in a.ravel()]


def kept_rows(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows that have a code."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.where(F.col(vector).isNotNull() & ~bad)


def train(rows: DataFrame, vector_id: str = "vec_id", vector: str = "embedding", parts: int = 4,
          entries: int = 256, rounds: int = 4) -> list[np.ndarray]:
    """The codebooks, one array of integers (entry x component) per part; empty for
    no rows.  ``rows`` are kept rows."""
    spark = rows.sparkSession
    rows = rows.select(F.col(vector_id).alias("i"), F.col(vector).cast("array<double>").alias("v"))
    dim = rows.agg(F.max(F.size("v"))).first()[0]
    if dim is None:
        return []
    dim = -(-dim // parts) * parts
    start = rows.orderBy(F.col("i").asc_nulls_last(), "v").limit(entries).collect()
    first = integers(pa.array([r["v"] for r in start], pa.list_(pa.float64())), dim)
    books = [narrow(b) for b in _parts(first, parts)]
    if not dim:
        return books
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast({"books": books})

        def partial(batches, sent=sent):
            books = [Codebook(b) for b in sent.value["books"]]
            counts = [np.zeros(len(b.entries), np.int64) for b in books]
            totals = [np.zeros(b.entries.shape, np.int64) for b in books]
            for batch in batches:
                q = integers(batch.column(1), dim)
                for p, (book, x) in enumerate(zip(books, _parts(q, parts), strict=True)):
                    at, _ = book.nearest(x)
                    counts[p] += np.bincount(at, minlength=len(counts[p]))
                    if x.dtype == object and totals[p].dtype != object:
                        totals[p] = _whole(totals[p])
                    np.add.at(totals[p], at, x if totals[p].dtype == object and x.dtype == object else
                              _whole(x) if totals[p].dtype == object else x.astype(np.int64))
            yield _batch({(p, e): (int(n[e]), totals[p][e]) for p, n in enumerate(counts) for e in np.flatnonzero(n).tolist()})

        def together(batches):
            sums: dict = {}
            for batch in batches:
                for row in batch.to_pylist():
                    n, total = sums.get((row["p"], row["e"]), (0, 0))
                    more = np.array([int(x) for x in row["total"]], object)
                    sums[row["p"], row["e"]] = n + row["n"], total + more
            yield _batch(sums)

        form = "p int, e int, n long, total array<string>"
        got = rows.mapInArrow(partial, form).repartition("p", "e").mapInArrow(together, form).collect()
        books = [_whole(b) if b.dtype != object else b.copy() for b in books]
        for row in got:
            books[row["p"]][row["e"]] = [int(x) // row["n"] for x in row["total"]]
        books = [narrow(b) for b in books]
    return books


def _batch(sums: dict) -> pa.RecordBatch:
    keys = list(sums)
    return pa.RecordBatch.from_arrays([
        pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
        pa.array([sums[k][0] for k in keys], pa.int64()),
        pa.array([_texts(sums[k][1]) for k in keys], pa.list_(pa.string()))], ["p", "e", "n", "total"])


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(x for b in books for x in _texts(b)).encode()).hexdigest()


def encode(rows: DataFrame, books: list[np.ndarray], vector: str = "embedding", code: str = "code",
           error: str = "error") -> DataFrame:
    """Kept ``rows`` with their code (two hex digits per part) and the sum of the
    squared distances to the entries (columns of those names give way)."""
    rows = rows.drop(code, error)
    sent = rows.sparkSession.sparkContext.broadcast({"books": books})
    parts, dim = len(books), sum(b.shape[1] for b in books)
    schema = T.StructType([*rows.schema.fields, T.StructField(code, T.StringType()), T.StructField(error, T.LongType())])

    def run(batches):
        books = [Codebook(b) for b in sent.value["books"]]
        for batch in batches:
            q = integers(batch.column(batch.schema.names.index(vector)), dim)
            found = [book.nearest(x) for book, x in zip(books, _parts(q, parts), strict=True)] if parts else []
            codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8) if parts else np.zeros((len(q), 0), np.uint8)
            codes = [c.tobytes().hex() for c in codes]
            errors = [int(e) for e in sum((d2 for _, d2 in found), np.zeros(len(q)))]
            yield pa.RecordBatch.from_arrays([
                *batch.columns, pa.array(codes, pa.string()),
                pa.array([e if e < 2**63 else None for e in errors], pa.int64())], schema.names)

    return rows.mapInArrow(run, schema)


def op13_gnat(spark, sf_dir: str, parts: int = 4, entries: int = 256, rounds: int = 4) -> DataFrame:
    """Code and error of every kept vector, the error of its label, and the digest
    of the codebooks."""
    rows = kept_rows(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    books = train(rows, parts=parts, entries=entries, rounds=rounds)
    coded = land(encode(rows, books).select("vec_id", "label", "code", "error"), "codes")
    # one row per label; it is broadcast only if its written size is below the session's threshold
    total = F.when(F.count("error") == F.count("*"), F.sum(F.col("error").cast("decimal(38,0)")))
    labels = land(coded.groupBy(F.col("label").alias("l")).agg(total.alias("t")), "labels").select(
        "l", F.expr("try_cast(t as bigint)").alias("label_error"))
    return coded.join(labels, F.col("label").eqNullSafe(F.col("l")), "left").select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


# ---------- the contract in SQL, by comparing every part with every entry

def _sql(rounds: int = 4, entries: int = 256) -> str:
    squares = "list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))"

    def assigned(r: int) -> str:
        return f"""
near{r} AS MATERIALIZED (
  SELECT n, p, min({{'d': d, 'e': e}}) AS best
  FROM (SELECT n, x.p, e, {squares} AS d FROM parts x JOIN book{r} b ON b.p = x.p) GROUP BY n, p)"""

    steps = [assigned(0)]
    for r in range(rounds):
        steps.append(f"""
sums{r} AS (
  SELECT p, e, i, sum(v) AS s, count(*) AS k
  FROM (SELECT x.p, best.e AS e, unnest(x.x) AS v, unnest(range(1, len(x.x) + 1)) AS i FROM parts x JOIN near{r} USING (n, p)) GROUP BY p, e, i),
book{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(m.c, b.c) AS c
  FROM book{r} b LEFT JOIN (SELECT p, e, list(CAST((s - ((s % k) + k) % k) // k AS BIGINT) ORDER BY i) AS c FROM sums{r} GROUP BY p, e) m USING (p, e))""")
        steps.append(assigned(r + 1))
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS n, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS MATERIALIZED (
  SELECT n, p, v[CAST(p * len(v) // 4 + 1 AS BIGINT):CAST((p + 1) * len(v) // 4 AS BIGINT)] AS x
  FROM (SELECT n, v, unnest(range(4)) AS p FROM kept)),
book0 AS MATERIALIZED (SELECT p, n - 1 AS e, x AS c FROM parts WHERE n <= {entries}),{",".join(steps)},
coded AS (
  SELECT n, string_agg(lpad(to_hex(best.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY n),
digest AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds})
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM kept JOIN coded USING (n), digest"""


OP13_SQL = _sql()
