"""Token counts of a BPE piece model by the whole-token shortcut.

Offline (once, on the driver, over the vocabulary only) two things are proved.
*Cuts*: a pattern splits texts into pre-tokens, and every piece is matched whole by
it; since a merge always makes a piece, no merge reaches over a cut, so a text has
as many tokens as its pre-tokens together.  The pattern is the finest of three for
which this holds.  *Whole tokens*: the merges are run on every piece standing
alone; where one symbol is left, that string is one token wherever it stands as a
pre-token.  Texts are then cut, pre-tokens that are whole tokens count one without
any merging, and only the rest is merged (each once per worker, in a bounded
cache).

Null and empty texts have no tokens.  Special strings in a text are ordinary text,
as in the library.  Repeated rows and ids are counted row by row; an empty table
gives no rows.  A pre-token of any length is merged, a long one in n log n steps.
"""

from __future__ import annotations

import re
import struct
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small, table
from .pieces import _fields

SPACE = "▁"
LIMIT = 4096
_CACHE, _KEEP = 300_000, 48  # merged pre-tokens that a worker keeps, characters of such a one
_AT_ONCE = 1 << 20  # longer texts are cut piece by piece instead of into one list


def piece_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_model(raw: bytes) -> dict:
    """What counting needs of a model file: the cost of each ordinary piece (the
    lowest is merged first) and the normaliser's switches.  Models that are no BPE,
    have no byte fallback, map characters or define own pieces are refused."""
    costs, kinds, trainer, normal = {}, set(), {}, {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            kind = piece.get(3, 1)
            kinds.add(kind)
            if kind == 1:
                costs[piece[1].decode()] = -struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normal = dict(_fields(value))
    if trainer.get(3, 1) != 2 or 6 not in kinds:
        raise ValueError("only BPE models with byte fallback are supported")
    if normal.get(2) or trainer.get(24) or kinds & {4, 5}:
        raise ValueError("character maps, space suffixes, user-defined and unused pieces are not supported")
    return {"costs": costs, "prefix": normal.get(3, 1), "collapse": normal.get(4, 1), "escape": normal.get(5, 1)}


def merged(text: str, costs: dict[str, float]) -> list[str]:
    """Symbols left when the cheapest adjacent pair, the leftmost of equal ones, is
    merged again and again: over a list of the pairs' costs, beyond 64 characters
    over a heap."""
    if len(text) > 64:
        return _merged_long(text, costs)
    sym, get, none = list(text), costs.get, float("inf")
    pairs = [get(a + b, none) for a, b in zip(text, text[1:])]
    while pairs:
        least = min(pairs)
        if least == none:
            break
        i = pairs.index(least)
        both = sym[i] + sym[i + 1]
        sym[i:i + 2] = [both]
        del pairs[i]
        if i:
            pairs[i - 1] = get(sym[i - 1] + both, none)
        if i < len(pairs):
            pairs[i] = get(both + sym[i + 1], none)
    return sym


def _merged_long(text: str, costs: dict[str, float]) -> list[str]:
    sym, n = list(text), len(text)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = []
    for i in range(n - 1):
        cost = costs.get(sym[i] + sym[i + 1])
        if cost is not None:
            heap.append((cost, i, 2))
    heapify(heap)
    while heap:
        _, i, size = heappop(heap)
        left = sym[i]
        j = after[i]
        if not left or j >= n or len(left) + len(sym[j]) != size:
            continue  # one of the two has been merged with another symbol since
        sym[i], sym[j] = left + sym[j], ""
        k = after[i] = after[j]
        h = before[i]
        if k < n:
            before[k] = i
            cost = costs.get(sym[i] + sym[k])
            if cost is not None:
                heappush(heap, (cost, i, len(sym[i]) + len(sym[k])))
        if h >= 0:
            cost = costs.get(sym[h] + sym[i])
            if cost is not None:
                heappush(heap, (cost, h, len(sym[h]) + len(sym[i])))
    return [s for s in sym if s]


def _tokens(symbols: list[str], costs: dict[str, float]) -> int:
    return sum(1 if s in costs else len(s.encode("utf-8", "replace")) for s in symbols)


def cutter(costs: dict[str, float]) -> str:
    """The finest of three patterns that matches every piece whole: letters and
    other characters apart, each with the spaces before it; parts between spaces;
    the whole text."""
    odd = "".join(re.escape(c) for c in sorted(set("".join(costs))) if re.match(r"[^\W\d_]", c) and not c.isalpha())
    letters = f"[^\\W\\d_{odd}]"
    for pattern in (f"{SPACE}*+{letters}++|{SPACE}*+(?:[^\\w{SPACE}]++|[\\d_{odd}]++)++|{SPACE}++",
                    f"{SPACE}*+[^{SPACE}]++|{SPACE}++"):
        whole = re.compile(pattern).fullmatch
        first = re.compile(pattern).match
        if all(whole(p) and first(p).end() == len(p) for p in costs):
            return pattern
    return "(?s:.+)"


def whole_tokens(costs: dict[str, float], pattern: str) -> list[str]:
    """The pieces that, standing alone, are merged into one token."""
    cut = re.compile(pattern).fullmatch
    return [p for p in costs if cut(p) and (len(p) == 1 or merged(p, costs) == [p])]


def compile_model(raw: bytes) -> dict:
    """The model with its cuts and whole tokens; this is what executors get."""
    model = read_model(raw)
    model["cut"] = cutter(model["costs"])
    model["whole"] = whole_tokens(model["costs"], model["cut"])
    return model


class Counter(dict):
    """Pre-token to its number of tokens: whole tokens from the start, others when
    they are first met."""

    def __init__(self, model: dict):
        super().__init__(dict.fromkeys(model["whole"], 1))
        self.model, self.costs, self.kept = model, model["costs"], []
        self.cut = re.compile(model["cut"])

    def __missing__(self, pre: str) -> int:
        n = _tokens(merged(pre, self.costs), self.costs)
        if len(pre) <= _KEEP:
            if len(self.kept) >= _CACHE:
                for old in self.kept:
                    del self[old]
                self.kept = []
            self[pre] = n
            self.kept.append(pre)
        return n

    def count(self, text: str | None) -> int:
        text = text or ""
        if self.model["collapse"]:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return 0
        text = " " + text if self.model["prefix"] else text
        text = text.replace(" ", SPACE) if self.model["escape"] else text
        if len(text) <= _AT_ONCE:
            return sum(map(self.__getitem__, self.cut.findall(text)))
        return sum(self[m[0]] for m in self.cut.finditer(text))


def count_tokens(docs: DataFrame, model: str | None = None, text: str = "text", out: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of ``text`` in column ``out`` (a column of
    that name gives way)."""
    docs = docs.drop(out)
    with open(model or piece_path(), "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast({"model": compile_model(f.read())})
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def run(batches):
        counter = sent.value.get("counter")
        if counter is None:
            counter = sent.value["counter"] = Counter(sent.value["model"])
        for batch in small(batches):
            texts = batch.column(batch.schema.names.index(text)).to_pylist()
            counts = pa.array([counter.count(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, counts], schema.names)

    return docs.mapInArrow(run, schema)


def op11_whole_tokens(spark, sf_dir: str, model: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Bytes and tokens of every document, and whether it is over ``limit`` tokens."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, model).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens",
        (F.col("n_tokens") > limit).alias("over_limit"))
