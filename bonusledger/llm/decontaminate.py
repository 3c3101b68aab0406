"""Benchmark decontamination with a generalised suffix automaton.

The words of all benchmark items make one automaton.  Documents are streamed
through it word by word; the state reached is the longest suffix read so far that
occurs in an item.  A match of at least ``window`` words (or of a whole item that
is shorter) is a hit: its words are covered and the items that hold its last
window are noted.

Items are cut into blocks of at most ``block_words`` words; each block makes one
automaton, so what is sent to the executors at once is bounded, and a document
passes the blocks one after another within its task (``decontaminate`` lands what
is found after ``AT_ONCE`` of them).  Nulls have no words; an
empty benchmark leaves all documents as they are; repeated items count each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land, small

WINDOW = 10
BLOCK_WORDS = 200_000
AT_ONCE = 4  # blocks whose automata a task of ``decontaminate`` holds
# Separators are the ASCII characters but letters and digits; A-Z are lower-cased.
_SPACE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_SPACE).split() if text else []


class Automaton:
    """Generalised suffix automaton over items given as lists of words."""

    def __init__(self, items: list[tuple[int, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.size = [-1], [0]
        self.need: dict[int, int] = {}  # state -> words that a match needs for the state's own window or short item
        self.items: list[frozenset] = []  # state -> items with a window that ends with the state's words
        for _, seq in items:
            last = 0
            for w in seq:
                last = self._extend(last, w)
        own: dict[int, set] = {}
        for item, seq in items:
            self._mark(item, seq, own)
        none: frozenset = frozenset()
        self.items, self.longest = [none] * len(self.size), [0] * len(self.size)
        for v in sorted(range(1, len(self.size)), key=self.size.__getitem__):
            up = self.items[self.link[v]]
            self.items[v] = up | own[v] if v in own else up
            self.longest[v] = self.need.get(v, self.longest[self.link[v]])

    def _state(self, size: int, link: int, trans: dict) -> int:
        self.next.append(trans)
        self.link.append(link)
        self.size.append(size)
        return len(self.size) - 1

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, size = self.next, self.link, self.size
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, q, w)
        cur, p = self._state(size[last] + 1, 0, {}), last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: bytes) -> int:
        twin = self._state(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = twin
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = twin
            p = self.link[p]
        return twin

    def _mark(self, item: int, seq: list[bytes], own: dict[int, set]) -> None:
        """Notes the item at the state of each of its windows.  A short item's
        state has its length exactly, since nothing stands before its words."""
        need, at = min(self.window, len(seq)), 0
        for n, w in enumerate(seq, 1):
            at = self.next[at][w]
            while self.size[self.link[at]] >= need:
                at = self.link[at]
            if n >= need:
                self.need[at] = need
                own.setdefault(at, set()).add(item)

    def scan(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Covered word ranges [from, to), merged and in order, and the items hit."""
        nxt, link, size, window, need, items, longest = (
            self.next, self.link, self.size, self.window, self.need, self.items, self.longest)
        spans: list[tuple[int, int]] = []
        found: set = set()
        at = n = 0
        for i, w in enumerate(seq):
            go = nxt[at].get(w)
            while go is None and at:
                at = link[at]
                n = size[at]
                go = nxt[at].get(w)
            if go is None:
                continue
            at, n = go, n + 1
            top = at if need.get(at, 0) <= n else link[at]
            if longest[top]:
                found |= items[top]
                start = i + 1 - (n if n >= window else longest[top])
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, i + 1))
        return spans, found


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, block_words: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    block, n = [], 0
    for row in benchmark.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        seq = words(bytes(row["text"])) if row["text"] is not None else []
        if seq:
            if n and n + len(seq) > block_words:
                yield block
                block, n = [], 0
            block.append((row["item_id"], seq))
            n += len(seq)
    yield block


FOUND = T.StructType([
    T.StructField("__n_words", T.LongType()),
    T.StructField("__from", T.ArrayType(T.LongType())),
    T.StructField("__to", T.ArrayType(T.LongType())),
    T.StructField("__items", T.ArrayType(T.LongType())),
])


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                 block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``__n_words``, the covered word ranges ``__from`` / ``__to``
    and the ids ``__items`` of the items found."""
    for block in _blocks(benchmark, block_words):
        docs = _scanned(docs, block, text, window)
    return docs


def _scanned(docs: DataFrame, block: list[tuple[int, list[bytes]]], text: str, window: int) -> DataFrame:
    """``docs`` with the columns of ``FOUND``, added to by one block of items."""
    fields = [f for f in docs.schema.fields if f.name not in FOUND.names]
    schema = T.StructType([*fields, *FOUND.fields])
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        automaton = Automaton(sent.value, window)
        for batch in small(batches):
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            old = [cols[f.name].to_pylist() if f.name in cols else None for f in FOUND.fields]
            out: list[list] = [[], [], [], []]
            for i, t in enumerate(cols[text].cast(pa.binary()).to_pylist()):
                seq = words(t)
                spans, found = automaton.scan(seq)
                if old[1] is not None:
                    spans = _merged([*spans, *zip(old[1][i], old[2][i], strict=True)])
                    found |= set(old[3][i])
                for to, value in zip(out, (len(seq), [a for a, _ in spans], [b for _, b in spans],
                                           [x for x in found if x is not None]), strict=True):
                    to.append(value)
            for f, values in zip(FOUND.fields, out, strict=True):
                cols[f.name] = pa.array(values, pa.int64() if f.name == "__n_words" else pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([cols[f.name] for f in schema.fields], [f.name for f in schema.fields])

    return docs.mapInArrow(scan, schema)


def _without(t: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words [from, to) of the spans."""
    place = [m.span() for m in _WORD.finditer(t.translate(_SPACE))]
    parts, done = [], 0
    for a, b in spans:
        parts.append(t[done:place[a][0]])
        done = place[b - 1][1]
    return b"".join([*parts, t[done:]])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW,
                  max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` without covered spans in ``text``; a document of which more than
    ``max_coverage`` of the words are covered by all items together goes.  Cutting
    may bring words together that make a new window, so a text is cut until it has
    none.  The result does not depend on ``block_words``: with several blocks each
    round finds the spans of all blocks before it cuts, and texts that were cut go
    round again."""
    blocks = _blocks(benchmark, block_words)
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _cut_at_once(docs, block, text, window, max_coverage)
    parts, names, most = [], docs.columns, max_coverage
    while True:
        found = docs
        for n, block in enumerate(_blocks(benchmark, block_words), 1):
            found = _scanned(found, block, text, window)
            if n % AT_ONCE == 0:
                found = land(found, "matches")
        cut = land(_cut(found, names, text, most), "cut")
        parts.append(cut.where("not __again").select(*names))
        docs, most = cut.where("__again").select(*names), None
        if docs.isEmpty():
            break
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _cut(found: DataFrame, names: list[str], text: str, max_coverage: float | None) -> DataFrame:
    """The columns ``names`` with the found spans cut from the text, and whether
    there were any (``__again``); above ``max_coverage`` (if given) a row goes."""
    schema = T.StructType([*(found.schema[n] for n in names), T.StructField("__again", T.BooleanType())])

    def run(batches):
        for batch in small(batches):
            cols = dict(zip(batch.schema.names, batch.columns, strict=True))
            keep, texts, again = [], [], []
            for i, (t, n, a, b) in enumerate(zip(cols[text].cast(pa.binary()).to_pylist(), *(
                    cols[k].to_pylist() for k in FOUND.names[:3]), strict=True)):
                spans = list(zip(a, b, strict=True))
                if max_coverage is not None and sum(y - x for x, y in spans) > max_coverage * n:
                    continue
                keep.append(i)
                texts.append(_without(t, spans) if spans else t)
                again.append(bool(spans))
            out = batch.select(names).take(pa.array(keep, pa.int64()))
            at = names.index(text)
            out = out.set_column(at, out.schema.field(at), pa.array(texts, pa.binary()).cast(out.schema.field(at).type))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(again, pa.bool_())], schema.names)

    return found.mapInArrow(run, schema)


def _cut_at_once(docs: DataFrame, block: list[tuple[int, list[bytes]]], text: str, window: int,
                 max_coverage: float) -> DataFrame:
    """All rounds in one pass, for items that make one block."""
    sent = docs.sparkSession.sparkContext.broadcast(block)

    def cut(batches):
        automaton = Automaton(sent.value, window)
        for batch in small(batches):
            at = batch.schema.names.index(text)
            keep, texts = [], []
            for i, t in enumerate(batch.column(at).cast(pa.binary()).to_pylist()):
                seq = words(t)
                spans = automaton.scan(seq)[0]
                if sum(b - a for a, b in spans) > max_coverage * len(seq):
                    continue
                while spans:
                    t = _without(t, spans)
                    spans = automaton.scan(words(t))[0]
                keep.append(i)
                texts.append(t)
            out = batch.take(pa.array(keep, pa.int64()))
            yield out.set_column(at, out.schema.field(at), pa.array(texts, pa.binary()).cast(out.schema.field(at).type))

    return docs.mapInArrow(cut, docs.schema)


def op5_suffix_automaton(spark, sf_dir: str) -> DataFrame:
    """Words of each document that lie in windows of benchmark items."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")
    hit = F.aggregate(F.zip_with("__from", "__to", lambda a, b: b - a), F.lit(0).cast("long"), lambda s, x: s + x)
    ids = F.concat_ws(",", F.array_sort(F.transform(F.array_distinct("__items"), lambda x: x.cast("string"))))
    return found.select(
        "doc_id", F.col("__n_words").alias("n_words"), hit.alias("n_hit"),
        F.size(F.array_distinct("__items")).cast("long").alias("n_items"),
        F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


OP5_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM win),
grams AS (
  SELECT r, k, i, array_to_string(w[i : i + k - 1], ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, sizes WHERE len(w) >= k)),
found AS (SELECT grams.r, grams.i, win.k, win.item_id FROM grams JOIN win USING (k, g)),
hits AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits ON d.r = hits.r LEFT JOIN items ON d.r = items.r
"""
