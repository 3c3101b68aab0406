"""SentencePiece encoding and decoding as a weighted finite-state transducer.

The model file is compiled into a normaliser (spaces become U+2581, a leading one
is added), a trie of the pieces whose final states emit ids, and byte fallback
arcs for characters that no piece knows.  Composed with a text this is a lattice
over its positions, and the ids are its shortest path in the tropical semiring.
The models are BPE models, whose merge order no sum of piece scores can stand for,
so the weights sit on neighbouring pieces: free if the two are a stable pair
(merging their joined characters yields just these two), otherwise infinite.  A
piece sequence is the BPE result exactly if all its neighbours are stable, so one
path of finite length is left, and a position has one live state.

No piece has U+2581 after another character, or a letter before a character that
is none (checked when compiling, else texts stay whole), so a text falls into
chunks that are solved once and kept in a bounded cache.  Null and empty texts have no ids.  U+2581 in a text decodes to a
space, as the format has it; all else comes back exactly.
"""

from __future__ import annotations

import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
_CACHE, _LONGEST = 400_000, 48  # chunks and pairs that a worker keeps, characters of such a chunk


def _fields(raw: bytes):
    """(number, value) of each field of a protobuf message."""
    at = 0

    def varint():
        nonlocal at
        out = shift = 0
        while True:
            b = raw[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, raw[at:at + n]
            at += n


class Transducer:
    NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6

    def __init__(self, raw: bytes):
        self.pieces: list[str] = []
        self.costs: list[float] = []
        kinds, trainer, normal = [], {}, {}
        for number, value in _fields(raw):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.costs.append(-struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, self.NORMAL))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normal = dict(_fields(value))
        if trainer.get(3, 1) != 2:
            raise ValueError("only BPE models are supported")
        if normal.get(2) or trainer.get(24) or self.USER in kinds or self.UNUSED in kinds:
            raise ValueError("character maps, space suffixes, user-defined and unused pieces are not supported")
        self.prefix, self.collapse, self.escape = normal.get(3, 1), normal.get(4, 1), normal.get(5, 1)
        self.unknown = kinds.index(self.UNKNOWN)
        self.bytes = [i for i, k in enumerate(kinds) if k == self.BYTE]
        self.ids = {p: i for i, p in enumerate(self.pieces) if kinds[i] == self.NORMAL}
        self.trie: dict = {}
        for p, i in self.ids.items():
            node = self.trie
            for c in p:
                node = node.setdefault(c, {})
            node[""] = i
        self.known = set("".join(self.ids))
        word = "" if any(re.search(r"[^\W\d_]\W", p) for p in self.ids) else f"{SPACE}*[^\\W\\d_]+(?!\\w)|"
        self.chunks = re.compile(f"[\n\t]|{word}{SPACE}*[^{SPACE}\n\t]+|{SPACE}+", re.S)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p or "\t" in p for p in self.ids):
            self.chunks = re.compile(".+", re.S)
        self.pairs: dict = {}
        self.cache: dict[str, bytes] = {}
        self.out = [b"" if k == self.CONTROL else " ⁇ ".encode() if k == self.UNKNOWN else
                    bytes([int(p[1:-1], 16)]) if k == self.BYTE else p.replace(SPACE, " ").encode()
                    for p, k in zip(self.pieces, kinds, strict=True)]

    def normalise(self, text: str) -> str:
        if self.collapse:
            text = " ".join(x for x in text.split(" ") if x)
        if not text:
            return ""
        text = " " + text if self.prefix else text
        return text.replace(" ", SPACE) if self.escape else text

    def _merged(self, text: str) -> list[str]:
        """Pieces left when the best pair is merged again and again."""
        seq, ids, costs = list(text), self.ids, self.costs
        while len(seq) > 1:
            best, at = None, -1
            for i in range(len(seq) - 1):
                p = ids.get(seq[i] + seq[i + 1])
                if p is not None and (best is None or costs[p] < best):
                    best, at = costs[p], i
            if best is None:
                break
            seq[at:at + 2] = [seq[at] + seq[at + 1]]
        return seq

    def _stable(self, a: int, b: int) -> bool:
        """Whether a piece (or -1, the start) may stand before another one."""
        key = (a, b)
        got = self.pairs.get(key)
        if got is None:
            two = [*([self.pieces[a]] if a >= 0 else []), self.pieces[b]]
            if len(self.pairs) > _CACHE:
                self.pairs.clear()
            got = self.pairs[key] = self._merged("".join(two)) == two
        return got

    def _arcs(self, run: str, i: int) -> list[tuple[int, int]]:
        """(end, piece) of the pieces that start at i, the longest last."""
        node, out = self.trie, []
        for j in range(i, len(run)):
            node = node.get(run[j])
            if node is None:
                break
            p = node.get("")
            if p is not None:
                out.append((j + 1, p))
        return out

    def _path(self, run: str) -> list[int]:
        """The path of finite length over characters that pieces know: long arcs
        are tried first, and a position from which none leads on is dead."""
        n, i, before, pairs = len(run), 0, -1, self.pairs
        path: list[int] = []
        tried: list[tuple] = []
        dead = bytearray(n + 1)
        arcs = self._arcs(run, 0)
        while True:
            while arcs:
                j, p = arcs.pop()
                if not dead[j]:
                    ok = pairs.get((before, p))
                    if self._stable(before, p) if ok is None else ok:
                        break
            else:
                dead[i] = 1
                path.pop()
                i, before, arcs = tried.pop()
                continue
            path.append(p)
            if j == n:
                return path
            tried.append((i, before, arcs))
            i, before, arcs = j, p, self._arcs(run, j)

    def solve(self, chunk: str) -> list[int]:
        """Ids on the shortest path from the chunk's start to its end."""
        known = self.known
        if known.issuperset(chunk):
            return self._path(chunk)
        out: list[int] = []
        at = 0
        for i, c in enumerate(chunk):
            if c not in known:
                if at < i:
                    out += self._path(chunk[at:i])
                if self.bytes:
                    out += [self.bytes[b] for b in c.encode("utf-8", "replace")]
                elif not out or out[-1] != self.unknown:
                    out.append(self.unknown)
                at = i + 1
        return out + self._path(chunk[at:]) if at < len(chunk) else out

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian 32-bit integers."""
        parts, cache = [], self.cache
        for chunk in self.chunks.findall(self.normalise(text or "")):
            got = cache.get(chunk)
            if got is None:
                ids = self.solve(chunk)
                got = struct.pack(f"<{len(ids)}i", *ids)
                if len(chunk) <= _LONGEST:
                    if len(cache) >= _CACHE:
                        cache.clear()
                    cache[chunk] = got
            parts.append(got)
        return b"".join(parts)

    def decode(self, ids) -> str:
        out = b"".join([self.out[i] for i in ids]).decode("utf-8", "replace")
        return out[1:] if self.prefix and out[:1] == " " else out


def _model(path: str) -> dict:
    """What is sent to the executors; a worker keeps the transducer in it."""
    with open(path, "rb") as f:
        return {"model": f.read()}


def _transducer(sent) -> Transducer:
    if "made" not in sent.value:
        sent.value["made"] = Transducer(sent.value["model"])
    return sent.value["made"]


def encode(docs: DataFrame, model: str = MODEL, text: str = "text", out: str = "ids") -> DataFrame:
    """``docs`` with the ids of ``text`` as array<int> in column ``out`` (a column
    of that name gives way)."""
    docs = docs.drop(out)
    sent = docs.sparkSession.sparkContext.broadcast(_model(model))
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches):
        fst = _transducer(sent)
        for batch in small(batches):
            got = [fst.encode(t) for t in batch.column(batch.schema.names.index(text)).to_pylist()]
            ends = np.cumsum([0, *(len(g) // 4 for g in got)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns, ids], schema.names)

    return docs.mapInArrow(run, schema)


def decode(rows: DataFrame, model: str = MODEL, ids: str = "ids", out: str = "text") -> DataFrame:
    """``rows`` with the text of the ids in column ``out`` (a column of that name
    gives way); null ids give null."""
    rows = rows.drop(out)
    sent = rows.sparkSession.sparkContext.broadcast(_model(model))
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches):
        fst = _transducer(sent)
        for batch in small(batches):
            got = [None if x is None else fst.decode(x) for x in batch.column(batch.schema.names.index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], schema.names)

    return rows.mapInArrow(run, schema)


def op7_transducer(spark, sf_dir: str, model: str = MODEL) -> DataFrame:
    """Every document encoded and decoded: number of ids, SHA-256 of the ids as
    little-endian 32-bit integers, number of ids from byte fallback, and whether
    decoding gives the text back (U+2581 as a space, null as empty)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    sent = spark.sparkContext.broadcast(_model(model))
    schema = "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded boolean"

    def run(batches):
        import hashlib

        fst = _transducer(sent)
        is_byte = np.zeros(len(fst.pieces), bool)
        is_byte[fst.bytes] = True
        for batch in small(batches):
            rows = []
            for t in batch.column(1).to_pylist():
                raw = fst.encode(t)
                ids = np.frombuffer(raw, "<i4")
                back = fst.decode(ids.tolist()) == (t or "").replace(SPACE, " ")
                rows.append((len(ids), int(is_byte[ids].sum()), hashlib.sha256(raw).hexdigest(), back))
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()),
                pa.array(cols[2], pa.string()), pa.array(cols[3], pa.bool_())],
                ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
