"""Repeated byte strings by suffix sorting in two stages.

Every byte covered by a string of ``length`` bytes that also starts elsewhere is
removed.  Equal texts are one text with a count.  So that equal strings meet, each
window of ``length`` bytes belongs to its minimizer, the window's k-gram of least
hash; a run of windows with one minimizer is a snippet (on average 280 bytes for
77 windows).  Minimizers seen once end there.  Equal snippets of the rest are one
with a count: all their windows repeat.  Different snippets with the same
minimizer are sorted: their suffixes are ordered in two stages (only suffixes not
larger than their successors are sorted directly, the others are induced from
them by a scan of the buckets of first bytes), and neighbours with a common prefix
of ``length`` bytes repeat.

Groups of snippets of one minimizer are sorted within one task, many groups at a
time, as long as they have at most ``GROUP`` windows.  The windows of larger groups
are counted by a 128-bit hash instead, in as many tasks as there are windows for.

Null texts are empty; texts shorter than ``length`` hold no such string and keep all
bytes.  Repeated rows are repeats of each
other.
"""

from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import run_folder
from .common import land, small

LENGTH, K = 200, 48
GROUP = 100_000  # windows of one minimizer that one task sorts at most
CHUNK = 1 << 20  # window starts handled at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_LOW = np.uint64((1 << 21) - 1)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate([one, np.full(n, b, np.uint64)])) for b in (_BASE, _BACK))


class Minimizers:
    """Runs of windows by their minimizer: (hash, first start, windows) arrays."""

    def __init__(self, length: int = LENGTH, k: int = K):
        self.length, self.k, self.w = length, k, length - k + 1
        self.up, self.down = _powers(4096)

    def __call__(self, text: bytes):
        out = []
        for at in range(0, max(0, len(text) - self.length + 1), CHUNK):
            part = np.frombuffer(text, np.uint8)[at:at + CHUNK + self.length - 1]
            h, first, n = self._chunk(part)
            out.append((h, first + at, n))
        if not out:
            return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _chunk(self, b: np.ndarray):
        n, k, w = len(b), self.k, self.w
        if n > len(self.up):
            self.up, self.down = _powers(2 * n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        g = (sums[k:] - sums[:-k]) * self.down[:n - k + 1]
        g ^= g >> np.uint64(31)
        g *= np.uint64(0xD6E8FEB86659FD93)
        g ^= g >> np.uint64(32)
        # least hash of w neighbours, the first of equals: places stand in the low bits
        m, starts = len(g), n - self.length + 1
        v = np.full(-(-m // w) * w, np.iinfo(np.uint64).max, np.uint64)
        v[:m] = (g & ~_LOW) | np.arange(m, dtype=np.uint64)
        v = v.reshape(-1, w)
        left = np.minimum.accumulate(v, 1).ravel()
        right = np.minimum.accumulate(v[:, ::-1], 1)[:, ::-1].ravel()
        place = (np.minimum(right[:starts], left[w - 1:w - 1 + starts]) & _LOW).astype(np.int64)
        first = np.flatnonzero(np.diff(place, prepend=-1))
        return g[place[first]], first, np.diff(first, append=starts)


def suffix_order(buf: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The wanted places of ``buf`` in the order of what follows them, to ``depth``
    bytes.  ``buf`` ends with at least ``depth`` + 256 spare bytes.

    Suffixes whose first byte is larger than the next one are larger than their
    successors; those are induced, the others are sorted directly."""
    down = np.zeros(len(buf), bool)
    down[:-1] = buf[:-1] > buf[1:]
    need = np.zeros(len(buf), bool)
    need[wanted] = True
    more = wanted
    while len(more):  # an induced suffix needs the rank of its successor
        more = more[down[more]] + 1
        more = more[~need[more]]
        need[more] = True
    direct = np.flatnonzero(need & ~down)
    rows = np.lib.stride_tricks.sliding_window_view(buf, depth)[direct]
    direct = direct[np.argsort(np.ascontiguousarray(rows).view(f"S{depth}").ravel(), kind="stable")]
    induced = np.flatnonzero(need & down)
    heads = [np.split(x, np.searchsorted(buf[x], np.arange(1, 256))) for x in (
        induced[np.argsort(buf[induced], kind="stable")], direct)]
    rank = np.zeros(len(buf), np.int64)
    order, done = [], 0
    for larger, smaller in zip(*heads, strict=True):  # buckets of one first byte, ascending
        larger = larger[np.argsort(rank[larger + 1], kind="stable")]
        for part in (larger, smaller):
            rank[part] = np.arange(done, done + len(part))
            done += len(part)
            order.append(part)
    order = np.concatenate(order)
    keep = np.zeros(len(buf), bool)
    keep[wanted] = True
    return order[keep[order]]


def repeated(snippets: list[bytes], depth: int = LENGTH) -> list[np.ndarray]:
    """For each snippet, which of its windows of ``depth`` bytes start elsewhere in
    the snippets too."""
    counts = [max(0, len(s) - depth + 1) for s in snippets]
    offsets = np.cumsum([0, *(len(s) for s in snippets)])
    buf = np.frombuffer(b"".join(snippets) + bytes(depth + 256), np.uint8)
    wanted = np.concatenate([np.arange(o, o + n) for o, n in zip(offsets, counts, strict=False)]) if snippets else np.empty(0, int)
    again = np.zeros(len(buf), bool)
    if len(wanted) > 1:
        order = suffix_order(buf, wanted, depth)
        windows = np.lib.stride_tricks.sliding_window_view(buf, depth)
        common = np.empty(len(order) - 1, np.int32)  # adjacent common prefixes, up to depth
        for at in range(0, len(common), 1 << 15):
            differ = windows[order[at:at + (1 << 15)][:len(common) - at]] != windows[order[at + 1:at + 1 + (1 << 15)]]
            common[at:at + (1 << 15)] = np.where(differ.any(1), differ.argmax(1), depth)
        same = common >= depth
        again[order[:-1][same]] = True
        again[order[1:][same]] = True
    return [again[o:o + n] for o, n in zip(offsets, counts, strict=False)]


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(flags.astype(np.int8), prepend=0, append=0))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def _anchors(texts: DataFrame, length: int, wide: bool) -> DataFrame:
    """(h) or (h, sh, key, at, n): hash of the minimizer, hash of the snippet, and
    the snippet's text, first start and number of windows."""
    names = ["h", "sh", "key", "at", "n"] if wide else ["h"]

    def run(batches):
        cut = Minimizers(length)
        for batch in small(batches):
            hs, shs, at, ns, which = [], [], [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if len(t) < length:
                    continue
                h, first, n = cut(t)
                hs.append(h)
                if wide:
                    ends = (first + n + length - 1).tolist()
                    shs.append(np.fromiter((xxhash.xxh3_64_intdigest(t[a:b]) for a, b in zip(first.tolist(), ends, strict=True)), np.uint64, len(h)))
                    at.append(first)
                    ns.append(n)
                    which.append(np.full(len(h), i))
                if len(hs) >= 512:
                    yield pack(batch, hs, shs, at, ns, which)
                    hs, shs, at, ns, which = [], [], [], [], []
            if hs:
                yield pack(batch, hs, shs, at, ns, which)

    def pack(batch, hs, shs, at, ns, which):
        cols = [pa.array(_signed(np.concatenate(hs)))]
        if wide:
            cols += [pa.array(_signed(np.concatenate(shs))), batch.column(0).take(pa.array(np.concatenate(which))),
                     pa.array(np.concatenate(at), pa.int32()), pa.array(np.concatenate(ns), pa.int32())]
        return pa.RecordBatch.from_arrays(cols, names)

    return texts.select("key", "body").where(F.octet_length("body") >= length).mapInArrow(
        run, "h long, sh long, key binary, at int, n int" if wide else "h long")


def _snippets(texts: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``wanted`` (h, copies, key, at, n) with the snippets' bytes."""
    lists = wanted.groupBy("key").agg(F.collect_list(F.struct("h", "copies", "at", "n")).alias("all"))

    def run(batches):
        for batch in small(batches):
            out = []
            for key, body, rows in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(r["h"], r["copies"], key, r["at"], body[r["at"]:r["at"] + r["n"] + length - 1]) for r in rows]
            if out:
                h, c, k, at, s = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([
                    pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.binary()), pa.array(at, pa.int32()),
                    pa.array(s, pa.binary())], ["h", "copies", "key", "at", "snippet"])

    return texts.join(lists, "key").select("key", "body", "all").mapInArrow(
        run, "h long, copies long, key binary, at int, snippet binary")


def _sorted_repeats(snippets: DataFrame, length: int) -> DataFrame:
    """(key, from, to) of windows that repeat among the snippets of a minimizer."""

    def run(batches):
        def flush():
            got = []
            for (_, copies, key, at, _s), flags in zip(held, repeated([r[4] for r in held], length), strict=True):
                if copies == 1:
                    got += [(key, at + a, at + b + length - 1) for a, b in _runs(flags)]
            held.clear()
            return got

        held: list[tuple] = []
        size, out = 0, []
        for batch in small(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size > 2 * GROUP and row[0] != held[-1][0]:
                    out += flush()
                    size = 0
                held.append(row)
                size += len(row[4]) - length + 1
            if out:
                yield spans(out)
                out = []
        if held:
            yield spans(flush())

    def spans(rows):
        k, a, b = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(k, pa.binary()), pa.array(a, pa.int32()), pa.array(b, pa.int32())], ["key", "from", "to"])

    return snippets.repartition("h").sortWithinPartitions("h").select("h", "copies", "key", "at", "snippet").mapInArrow(
        run, "key binary, from int, to int")


def _counted_repeats(snippets: DataFrame, length: int) -> DataFrame:
    """The same for large groups: windows counted by hash."""

    def run(batches):
        for batch in small(batches):
            out = []
            for copies, key, at, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                out += [(xxhash.xxh3_128_digest(s[i:i + length]), copies, key, at + i) for i in range(len(s) - length + 1)]
            if out:
                w, c, k, a = zip(*out, strict=True)
                cols = [pa.array(w, pa.binary()), pa.array(c, pa.int64()), pa.array(k, pa.binary()), pa.array(a, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, ["w", "copies", "key", "from"])

    windows = snippets.select("copies", "key", "at", "snippet").mapInArrow(run, "w binary, copies long, key binary, from int")
    again = windows.groupBy("w").agg(F.sum("copies").alias("c")).where("c > 1").select("w")
    return windows.where("copies = 1").join(again, "w").select("key", "from", (F.col("from") + length).alias("to"))


@contextmanager
def distinct_texts(docs: DataFrame, text: str):
    """(key, body, copies) per distinct text, as a table bucketed by key, so that
    joins on key move no text.  The table leaves the catalog at the end."""
    spark = docs.sparkSession
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(F.unhex(F.md5(body)).alias("key"), body.alias("body")).groupBy("key").agg(
        F.first("body").alias("body"), F.count("*").alias("copies"))
    name = f"llm_texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (rows.write.option("path", f"{run_folder(spark)}/{name}").option("compression", "zstd").bucketBy(n, "key").saveAsTable(name))
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE {name}")


def repeats(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(key, from, to): covered byte ranges of ``distinct_texts``, not merged."""
    often = land(_anchors(texts, length, False).groupBy("h").count().where("count > 1").select("h"), "repeat-hashes")
    found = land(_anchors(texts, length, True).join(often, "h"), "repeat-anchors")
    groups = found.groupBy("h", "sh").agg(F.count("*").alias("copies"), F.min(F.struct("key", "at", "n")).alias("one"))
    groups = land(groups.select("h", "sh", "copies", "one.*"), "repeat-groups")
    mixed = groups.groupBy("h").agg(F.count("*").alias("m"), F.sum("n").alias("windows")).where("m > 1")
    snippets = land(_snippets(texts, groups.join(mixed.select("h"), "h"), length), "repeat-snippets")
    large = mixed.where(F.col("windows") > GROUP).select("h")
    whole = found.join(groups.where("copies > 1").select("h", "sh"), ["h", "sh"]).select(
        "key", F.col("at").alias("from"), (F.col("at") + F.col("n") + length - 1).alias("to"))
    return (whole.union(_sorted_repeats(snippets.join(large, "h", "left_anti"), length))
            .union(_counted_repeats(snippets.join(large, "h", "left_semi"), length)))


def _kept(texts: DataFrame, length: int, schema: str, names: list[str], row) -> DataFrame:
    """One row per distinct text, made by ``row`` from its bytes and removed ranges."""
    lists = repeats(texts, length).groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("spans"))

    def run(batches):
        for batch in small(batches):
            out = []
            for key, body, copies, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ranges: list[list[int]] = []
                if copies > 1 and len(body) >= length:
                    ranges = [[0, len(body)]]
                else:
                    for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
                        if ranges and a <= ranges[-1][1]:
                            ranges[-1][1] = max(b, ranges[-1][1])
                        else:
                            ranges.append([a, b])
                out.append((key, *row(body, ranges)))
            cols = list(zip(*out, strict=True)) or [[]] * len(names)
            types = [pa.binary(), *({"long": pa.int64(), "string": pa.string()}[t.split()[-1]] for t in schema.split(", ")[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)

    return texts.join(lists, "key", "left").select("key", "body", "copies", "spans").mapInArrow(run, schema)


def _without(body: bytes, ranges: list) -> bytes:
    parts, at = [], 0
    for a, b in ranges:
        parts.append(body[at:a])
        at = b
    return b"".join([*parts, body[at:]])


def _keyed(docs: DataFrame, text: str, kept: DataFrame) -> DataFrame:
    body = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    return docs.withColumn("__key", F.unhex(F.md5(body))).join(kept.withColumnRenamed("key", "__key"), "__key").drop("__key")


def without_repeats(docs: DataFrame, text: str = "text", length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated strings cut from ``text`` (bytes of cut characters go)."""
    with distinct_texts(docs, text) as texts:
        kept = land(_kept(texts, length, "key binary, __text string", ["key", "__text"],
                          lambda body, ranges: (_without(body, ranges).decode("utf-8", "ignore"),)), "repeat-texts")
    out = _keyed(docs, text, kept)
    return out.withColumn(text, F.when(F.col(text).isNotNull(), F.col("__text"))).drop("__text").select(docs.columns)


def op9_two_stage(spark, sf_dir: str) -> DataFrame:
    """Bytes of each document covered by repeated strings of 200 bytes."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    with distinct_texts(docs, "text") as texts:
        kept = land(_kept(
            texts, LENGTH, "key binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string",
            ["key", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            lambda body, ranges: (len(body), sum(b - a for a, b in ranges), len(ranges),
                                  hashlib.sha256(_without(body, ranges)).hexdigest())), "repeat-kept")
    return _keyed(docs, "text", kept).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
