"""Repair of conversations by a run-length min-plus DP.

A row of a conversation is one symbol: its role's initial and its fault (blank and
duplicate rows share one symbol, since they can only be deleted).  Equal consecutive
symbols are collapsed to runs.  What has been put out so far is one of four states
(nothing, a system row, a user row, an assistant row); a symbol's min-plus matrix
holds the cheapest edits from state to state over one row, insertions before it
included.  Costs to go advance over a run of any length by the cached binary powers
of that matrix, and the choices are then unrolled forwards, block by block of the
same powers, always with the ASCII-least letter that still reaches the least cost.

Order and equal rows: rows stand by turn (nulls first), then role and text.  Equal
rows are counted before anything is shuffled; ``n`` copies are one row and a run of
n - 1 duplicates.  Rows are dealt by ranges of that order, so that a conversation of
any length is spread over tasks.  Conversations inside one range are done there;
one that reaches over a border is done in pieces: its duplicates are looked for over
the pieces, only the runs of its pieces come together, and each piece unrolls its
own part of the audit into rows.

Null roles and texts stand for one space; an empty role has no initial and can't be
kept; null conversation ids are one conversation.  Copies may be 0: such a row is
not there, but its conversation is listed.  Conversations without rows have zeros
and an empty audit; an empty table gives no rows.  Other columns play no part.
"""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import land, table

BLANK = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
_NEVER = 1 << 100
# states: nothing, system, user, assistant; what an inserted or reroled row leads to
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
# symbols: 0 must go; else 1 + place of the initial in "sua" (3: another) + 4 if truncated
_GONE = 0


def symbol(initial: str, truncated: bool) -> int:
    return 1 + ("sua".index(initial) if initial and initial in "sua" else 3) + (4 if truncated else 0)


def _kept(sym: int, state: int) -> int | None:
    """The state after keeping the row, if that is allowed."""
    if sym == _GONE:
        return None
    initial = (sym - 1) % 4
    if initial == 0:
        return 1 if state == 0 else None
    if initial == 1:
        return 2 if state != 2 else None
    return 3 if initial == 2 and state == 2 else None


def _product(a, b):
    return tuple(tuple(min(x + y for x, y in zip(row, col, strict=True)) for col in zip(*b, strict=True)) for row in a)


def _applied(a, h):
    return tuple(min(x + y for x, y in zip(row, h, strict=True)) for row in a)


def _inserts():
    """Cheapest insertions from state to state."""
    one = [[0 if s == t else INSERT if _NEXT[s] == t else _NEVER for t in range(4)] for s in range(4)]
    return _product(_product(one, one), _product(one, one))


@cache
def power(sym: int, k: int):
    """The min-plus matrix of 2^k rows of a symbol."""
    if k:
        half = power(sym, k - 1)
        return _product(half, half)
    edit = [[_NEVER] * 4 for _ in range(4)]
    late = TRUNCATED if sym > 4 else 0
    for s in range(4):
        edit[s][s] = DELETE
        if sym != _GONE:
            edit[s][_NEXT[s]] = REROLE + late
            t = _kept(sym, s)
            if t is not None:
                edit[s][t] = min(edit[s][t], KEEP + late)
    return _product(_inserts(), edit)


END = tuple(min(c + (0 if t in (0, 3) else _NEVER) for t, c in enumerate(row)) for row in _inserts())


def _over(sym: int, n: int, h):
    """Costs to go before ``n`` rows of a symbol, from those after them."""
    k = 0
    while n:
        if n & 1:
            h = _applied(power(sym, k), h)
        n >>= 1
        k += 1
    return h


def _row(sym: int, state: int, h) -> tuple[str, int]:
    """Letters up to and with the row's own, and the state after it."""
    before = _applied(power(sym, 0), h)
    late = TRUNCATED if sym > 4 else 0
    out = ""
    while True:
        least = before[state]
        if DELETE + h[state] == least:
            return out + "D", state
        if INSERT + before[_NEXT[state]] == least:
            out, state = out + "I", _NEXT[state]
            continue
        t = _kept(sym, state)
        if t is not None and KEEP + late + h[t] == least:
            return out + "K", t
        return out + "R", _NEXT[state]


@lru_cache(1 << 14)
def _block(sym: int, k: int, state: int, h) -> tuple[str, int]:
    """Letters of 2^k rows, and the state after them.  ``h`` has 0 as its least."""
    if k == 0:
        return _row(sym, state, h)
    mid = _applied(power(sym, k - 1), h)
    a, state = _unrolled(sym, k - 1, state, mid)
    b, state = _unrolled(sym, k - 1, state, h)
    return a + b, state


def _unrolled(sym: int, k: int, state: int, h) -> tuple[str, int]:
    low = min(h)
    h = tuple(x - low for x in h)
    return _block(sym, k, state, h) if k < 12 else _block.__wrapped__(sym, k, state, h)


@lru_cache(1 << 14)
def _solved(runs: tuple) -> tuple[int, str, bool]:
    ends = [END]
    for sym, n in reversed(runs):
        ends.append(_over(sym, n, ends[-1]))
    cost = ends.pop()[0]
    audit, state, system = [], 0, False
    for sym, n in runs:
        h, blocks = ends.pop(), []
        for k in range(n.bit_length()):
            if n >> k & 1:
                blocks.append((k, h))
                h = _applied(power(sym, k), h)
        for k, after in reversed(blocks):
            letters, new = _unrolled(sym, k, state, after)
            system = system or state == 0 and letters.lstrip("D")[:1] == "K" and (sym - 1) % 4 == 0
            audit.append(letters)
            state = new
    audit.append({0: "", 3: "", 2: "I", 1: "II"}[state])
    return cost, "".join(audit), system


def solve(runs) -> tuple[int, str, bool]:
    """(least cost, audit, whether the first row put out is a system row) of runs
    (symbol, length).  Short lists of runs are remembered."""
    runs = tuple(runs)
    return _solved(runs) if len(runs) <= 64 else _solved.__wrapped__(runs)


class Piece:
    """Consecutive rows of a conversation, added in order."""

    def __init__(self):
        self.rows: list[tuple] = []  # role, text, copies
        self.seen: set = set()
        self.runs: list[list[int]] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.first = self.last = None

    def _run(self, sym: int, n: int) -> None:
        if n and self.runs and self.runs[-1][0] == sym:
            self.runs[-1][1] += n
        elif n:
            self.runs.append([sym, n])

    def add(self, turn, role: str, text: str, copies: int, duplicate: bool | None = None) -> None:
        """``duplicate`` is given where it is known already."""
        if not copies:
            return
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        initial = role[:1]
        if self.first is None:
            self.first = initial
        elif self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        self.illegal += copies - 1
        self.rows.append((role, text, copies))
        kept = text.rstrip(BLANK)
        if not kept:
            self.blank += copies
            self._run(_GONE, copies)
            return
        if duplicate is None:
            before = len(self.seen)
            self.seen.add((role, text))
            duplicate = len(self.seen) == before
        if duplicate:
            self.duplicate += copies
            self._run(_GONE, copies)
            return
        late = kept[-1] not in ".!?"
        self.truncated += late
        self._run(symbol(initial, late), 1)
        self.duplicate += copies - 1
        self._run(_GONE, copies - 1)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


def unroll(rows: list[tuple], audit: str, out: int = 0, system: bool = False) -> list[tuple[str, str]]:
    """Repaired (role, text) of rows with copies under their letters; ``out`` rows
    stand before them, the first of all being a system row if ``system``."""
    got, letters = [], iter(audit)
    odd = 1 if system else 0

    def made() -> str:
        return "user" if (out + len(got) - odd) % 2 == 0 else "assistant"

    for role, text, copies in rows:
        for _ in range(copies):
            letter = next(letters)
            while letter == "I":
                got.append((made(), ""))
                letter = next(letters)
            if letter != "D":
                got.append((role if letter == "K" else made(), text))
    for _ in letters:
        got.append((made(), ""))
    return got


_COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_DONE = "piece int, n_pieces int, " + ", ".join(f"{c} long" for c in _COUNTS) + \
    ", audit string, repaired array<struct<role: string, text: string>>"
_OPEN = "chunk int, turn long, role string, text string, copies long, again boolean"


def _schema(conv: T.DataType, *parts: str) -> T.StructType:
    fields = [f for part in parts for f in T.StructType.fromDDL(part).fields]
    return T.StructType([T.StructField("conv_id", conv), *fields])


def _batches(rows, arrow: pa.Schema, at_once: int = 500):
    """Arrow batches of rows given as dictionaries."""
    part = []
    for row in rows:
        part.append(row)
        if len(part) >= at_once:
            yield pa.RecordBatch.from_pylist(part, arrow)
            part = []
    if part:
        yield pa.RecordBatch.from_pylist(part, arrow)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _done(conv, piece: Piece) -> dict:
    cost, audit, system = solve([tuple(r) for r in piece.runs])
    return {"conv_id": conv, "piece": 0, "n_pieces": 1, "gaps": piece.gaps(), "blank": piece.blank,
            "duplicate": piece.duplicate, "truncated": piece.truncated, "illegal": piece.illegal, "cost": cost,
            "audit": audit, "repaired": [{"role": r, "text": t} for r, t in unroll(piece.rows, audit, 0, system)]}


def _chunk(arrow: pa.Schema):
    """Over one range of ordered rows: conversations inside it done, the first and
    the last one, which may reach over its borders, as open rows."""

    def run(batches):
        from itertools import groupby

        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId()

        def rows():
            for batch in batches:
                yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)

        def opened(conv, held, seen):
            for _, turn, role, text, copies in held:
                again = (role, text) in seen
                if copies and not again:
                    seen.add((role, text))
                yield {"conv_id": conv, "chunk": chunk, "turn": turn, "role": role, "text": text, "copies": copies,
                       "again": again}

        def results():
            first, before = True, None
            for conv, group in groupby(rows(), key=lambda r: r[0]):
                if first:
                    first = False
                    yield from opened(conv, group, set())
                    continue
                if before is not None:
                    piece = Piece()
                    for _, turn, role, text, copies in before[1]:
                        piece.add(turn, role, text, copies)
                    yield _done(before[0], piece)
                before = conv, list(group)
            if before is not None:
                yield from opened(before[0], before[1], set())

        yield from _batches(results(), arrow)

    return run


_SUMMARY = ("chunk int, runs array<struct<sym: int, n: long>>, rows long, turns long, low long, high long, "
            "blank long, duplicate long, truncated long, illegal long, first string, last string")


def _piece_of(rows: list[dict]) -> Piece:
    piece = Piece()
    for r in sorted(rows, key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"], r["text"])):
        piece.add(r["turn"], r["role"], r["text"], r["copies"], r["again"])
    return piece


def _summary(arrow: pa.Schema):
    def run(key, rows):
        p = _piece_of(rows.to_pylist())
        one = {"conv_id": key[0].as_py(), "chunk": key[1].as_py(), "runs": [{"sym": s, "n": n} for s, n in p.runs],
               "rows": sum(n for _, n in p.runs), "turns": p.turns, "low": p.low, "high": p.high, "blank": p.blank,
               "duplicate": p.duplicate, "truncated": p.truncated, "illegal": p.illegal, "first": p.first, "last": p.last}
        return pa.Table.from_pylist([one], arrow)

    return run


def _joined(arrow: pa.Schema):
    """The pieces of a conversation solved together: counts, and each piece's part
    of the audit with the number of rows put out before it."""

    def run(key, table):
        pieces = sorted(table.to_pylist(), key=lambda p: p["chunk"])
        full = [p for p in pieces if p["rows"]]
        runs: list[tuple] = []
        for p in full:
            for r in p["runs"]:
                if runs and runs[-1][0] == r["sym"]:
                    runs[-1] = (r["sym"], runs[-1][1] + r["n"])
                else:
                    runs.append((r["sym"], r["n"]))
        cost, audit, system = solve(runs)
        total = {c: sum(p[c] for p in full) for c in ("blank", "duplicate", "truncated", "illegal")}
        for a, b in zip(full, full[1:]):
            total["illegal"] += a["last"] + b["first"] not in ("su", "ua", "au")
        dated = [p for p in full if p["low"] is not None]
        turns = sum(p["turns"] for p in dated) - sum(a["high"] == b["low"] for a, b in zip(dated, dated[1:]))
        total["gaps"] = dated[-1]["high"] - dated[0]["low"] + 1 - turns if dated else 0
        out, at, put = [], 0, 0
        for i, p in enumerate(pieces):
            end, left = at, p["rows"]
            while left:
                left -= audit[end] != "I"
                end += 1
            if all(not q["rows"] for q in pieces[i + 1:]):
                end = len(audit)
            part, at = audit[at:end], end
            out.append({"conv_id": key[0].as_py(), "chunk": p["chunk"], "piece": i, "n_pieces": len(pieces), **total,
                        "cost": cost, "audit": part, "put": put, "system": system})
            put += len(part) - part.count("D")
        return pa.Table.from_pylist(out, arrow)

    return run


def _finished(arrow: pa.Schema):
    def run(key, rows, parts):
        part = parts.to_pylist()[0]
        got = unroll(_piece_of(rows.to_pylist()).rows, part["audit"], part["put"], part["system"])
        one = {n: part[n] for n in arrow.names if n in part}
        return pa.Table.from_pylist([one | {"repaired": [{"role": r, "text": t} for r, t in got]}], arrow)

    return run


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           copies: str | None = None) -> DataFrame:
    """Conversations repaired: one row per piece (conversations within a range of
    rows have one) with the counts of the whole conversation, the piece's letters of
    the audit and its repaired rows."""
    kind = rows.schema[conv].dataType
    space = F.lit(" ")
    counted = (rows.select(
        F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, space).alias("role"),
        F.coalesce(text, space).alias("text"), (F.col(copies) if copies else F.lit(1)).cast("long").alias("copies"))
        .groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")))
    # parts of long texts are enough to deal rows by ranges of the order they are sorted in
    ordered = counted.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions(
        "conv_id", "turn", "role", "text")
    schema = _schema(kind, _DONE, _OPEN)
    got = land(ordered.mapInArrow(_chunk(_arrow(schema)), schema), "conversations")

    done = _schema(kind, _DONE)
    opened = got.where("chunk is not null").select("conv_id", *(f.name for f in T.StructType.fromDDL(_OPEN).fields))
    # a row that its piece has not seen before is a duplicate if an earlier piece has it: a key has a row a piece
    same = Window.partitionBy("conv_id", "role", "text")
    new = opened.where("not again and copies > 0").withColumn("again", F.col("chunk") > F.min("chunk").over(same))
    opened = land(new.union(opened.where("again or copies = 0")), "open")
    summary, part = _schema(kind, _SUMMARY), _schema(kind, "chunk int", _DONE, "put long, system boolean")
    part = T.StructType([f for f in part.fields if f.name != "repaired"])
    parts = (opened.groupBy("conv_id", "chunk").applyInArrow(_summary(_arrow(summary)), summary)
             .groupBy("conv_id").applyInArrow(_joined(_arrow(part)), part))
    parts = land(parts, "audits")
    finished = opened.groupBy("conv_id", "chunk").cogroup(parts.groupBy("conv_id", "chunk")).applyInArrow(
        _finished(_arrow(done)), done)
    return got.where("chunk is null").select(done.names).union(finished)


def damage(rows: DataFrame) -> DataFrame:
    """The contract's damage by crc32 of ``conv_id:turn`` modulo 20; a dropped row
    keeps its conversation, with no copies."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"),
                    F.coalesce(F.col("turn").cast("string"), space))
    how = F.crc32(F.encode(name, "utf-8")) % 20
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"),
                       how.alias("how"))
    gone = F.col("how") == 0
    return rows.select(
        "conv_id", F.when(~gone, F.col("turn")).alias("turn"),
        F.when(gone, "").when(F.col("how") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(gone | (F.col("how") == 1), "").when(F.col("how") == 2, F.translate("text", ".!?", ""))
        .otherwise(F.col("text")).alias("text"),
        F.when(gone, 0).when(F.col("how") == 3, 2).otherwise(1).alias("copies"))


def _hashed(batches):
    """One digest per conversation of several pieces, which come in order: the
    pieces stream through, none is kept."""
    now, sha, audit, head, first = None, None, [], None, True
    arrow = None

    def row():
        return pa.RecordBatch.from_pylist([head | {"audit": "".join(audit), "repaired_sha256": sha.hexdigest()}], arrow)

    for batch in batches:
        if arrow is None:
            arrow = pa.schema([f for f in batch.schema if f.name not in ("piece", "lines")]
                              + [pa.field("repaired_sha256", pa.string())])
        for r in batch.to_pylist():
            if head is None or r["conv_id"] != now:
                if head is not None:
                    yield row()
                now, sha, audit, first = r["conv_id"], hashlib.sha256(), [], True
                head = {k: r[k] for k in r if k not in ("piece", "lines", "audit")}
            audit.append(r["audit"])
            if r["lines"] is not None:
                sha.update(("" if first else "\n").encode() + r["lines"].encode())
                first = False
    if head is not None:
        yield row()


def op12_run_length(spark, sf_dir: str) -> DataFrame:
    """Every conversation after damage: faults, least cost, audit, and the digest of
    the repaired rows."""
    pieces = repair(damage(table(spark, sf_dir, "conversations")), copies="copies")
    lines = F.when(F.size("repaired") > 0, F.array_join(F.transform(
        "repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n"))
    names = ["conv_id", *_COUNTS, "audit"]
    whole = pieces.where("n_pieces = 1").select(
        *names, F.sha2(F.encode(F.coalesce(lines, F.lit("")), "utf-8"), 256).alias("repaired_sha256"))
    several = (pieces.where("n_pieces > 1").select(*names, "piece", lines.alias("lines"))
               .repartition("conv_id").sortWithinPartitions("conv_id", "piece"))
    return whole.union(several.mapInArrow(_hashed, whole.schema))


# ---------- the contract in SQL: a recursive DP over single rows whose states are
# texts of nine digits of cost and the letters so far, so that the least text wins

def _more(state: str, cost: str, letter: str) -> str:
    return f"lpad(CAST(CAST(substr({state}, 1, 9) AS INTEGER) + {cost} AS VARCHAR), 9, '0') || substr({state}, 10) || '{letter}'"


_FAR = "'900000000'"
_BITS = "[0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]"
_CRC32 = ("xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(1, strlen({0}) + 1), "
          "lambda i: CAST(ascii(substr({0}, i, 1)) AS UBIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), " + _BITS + "), "
          "lambda x, k: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))))")
_IF = "CASE WHEN {} THEN {} ELSE " + _FAR + " END"

OP12_SQL = rf"""
WITH RECURSIVE named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hurt AS (
  SELECT *, CAST({_CRC32.format("name")} AS BIGINT) % 20 AS how FROM named),
damaged AS (
  SELECT conv_id, turn, CASE how WHEN 4 THEN 'user' ELSE role END AS role,
         CASE how WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hurt)),
convs AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
placed AS (
  SELECT g, turn, role, text, substr(role, 1, 1) AS initial,
         row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, text) AS i
  FROM damaged d JOIN convs c ON c.conv_id IS NOT DISTINCT FROM d.conv_id),
seen AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY g, role, text ORDER BY i) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS late, lag(initial) OVER (PARTITION BY g ORDER BY i) AS before
  FROM placed),
marked AS (
  SELECT *, blank OR again AS gone, CASE WHEN late THEN 3 ELSE 0 END AS extra FROM seen),
dp AS (
  SELECT g, 0::BIGINT AS i, '000000000' AS e, {_FAR} AS s, {_FAR} AS u, {_FAR} AS a FROM convs
  UNION ALL
  SELECT g, i, {_more("e", "4", "D")},
         least({_more("s", "4", "D")}, {_IF.format("NOT gone AND initial = 's'", _more("e", "extra", "K"))}),
         least({_more("u", "4", "D")}, {_IF.format("NOT gone", f"least({_more('e', '3 + extra', 'R')}, {_more('s', '3 + extra', 'R')}, {_more('a', '3 + extra', 'R')})")},
               {_IF.format("NOT gone AND initial = 'u'", f"least({_more('e', 'extra', 'K')}, {_more('s', 'extra', 'K')}, {_more('a', 'extra', 'K')})")}),
         least({_more("a", "4", "D")}, {_IF.format("NOT gone", _more("u", "3 + extra", "R"))},
               {_IF.format("NOT gone AND initial = 'a'", _more("u", "extra", "K"))})
  FROM (SELECT g, m.i, e, s, u, least(a, {_more("u", "3", "I")}) AS a, gone, initial, extra
        FROM (SELECT d.g, d.i, e, s, a, least(u, {_more("e", "3", "I")}, {_more("s", "3", "I")}, {_more("a", "3", "I")}) AS u FROM dp d) d
        JOIN marked m USING (g) WHERE m.i = d.i + 1)),
ends AS (
  SELECT g, least(e, a, {_more(f"least(u, {_more('s', '3', 'I')})", "3", "I")}) AS best
  FROM dp d WHERE d.i = (SELECT coalesce(max(m.i), 0) FROM marked m WHERE m.g = d.g)),
letters AS (
  SELECT g, pos, substr(best, CAST(9 + pos AS BIGINT), 1) AS letter
  FROM (SELECT g, best, unnest(range(1, strlen(best) - 8)) AS pos FROM ends)),
numbered AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w AS out
  FROM letters WINDOW w AS (PARTITION BY g ORDER BY pos ROWS UNBOUNDED PRECEDING)),
edited AS (
  SELECT n.g, pos, out, letter, m.role, CASE letter WHEN 'I' THEN '' ELSE m.text END AS text,
         max(CASE WHEN out = 1 AND letter = 'K' AND m.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.g) AS system
  FROM numbered n LEFT JOIN marked m ON m.g = n.g AND m.i = n.i AND n.letter <> 'I' WHERE letter <> 'D'),
repaired AS (
  SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (out - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text,
                       chr(10) ORDER BY pos) AS lines FROM edited GROUP BY g),
counts AS (
  SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (NOT blank AND again) AS duplicate, count(*) FILTER (NOT blank AND NOT again AND late) AS truncated,
         count(*) FILTER (i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY g)
SELECT conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(substr(best, 1, 9) AS BIGINT) AS cost,
       substr(best, 10) AS audit, sha256(coalesce(lines, '')) AS repaired_sha256
FROM convs JOIN ends USING (g) LEFT JOIN counts USING (g) LEFT JOIN repaired USING (g)"""
