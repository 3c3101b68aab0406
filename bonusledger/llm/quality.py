"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or abstain on every document.
Expectation-maximisation over the counts of all vote patterns (at most 3 to the
number of labellers) estimates how reliable each labeller is and how likely a
pattern is good.  These posteriors label a bounded sample, on which a hashed
linear scorer over character-shape n-grams and word statistics is trained; the
scorer then decides on every document.

Toxicity is a verdict of its own, since abuse stands in good prose too: see
``toxicity``.  It does not enter the quality, and it rejects a document whatever its
quality.

Null and empty texts score 0 and are rejected.  Equal texts get equal scores.  On
an empty table nothing is trained and no row comes out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import toxicity
from .common import small
from .weak import reliabilities, train

SAMPLE = 6000  # documents the scorer is trained on, at most
DIMS = 2048
# Frequent function words of the languages the labeller knows.
STOP = frozenset(
    "the of and to a in is that it for as with was on be by this are or from at an not he they have "
    "der die das und ist in den von zu mit sich des auf ein eine nicht dem im "
    "le la les de des et un une du en que qui dans pour sur au par est pas "
    "el los las y del se por con para su al lo como es".encode().split())
_KINDS = [(b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t", 3),
          (b"\n\r", 4), (b".", 5), (b",", 6), (b"!", 7), (b"?", 8), (b"#", 9), (b"$", 10), (b"%", 11), (b"&", 12),
          (b"*", 13), (b"|", 14), (b"\"'", 15), (b":;", 16), (b"-_", 17), (b"()[]{}", 18), (b"<>", 19), (b"/\\", 20),
          (b"@", 21), (b"+=", 22)]
_CLASS = np.full(256, 23, np.int64)
_CLASS[128:] = 0  # letters of other scripts
for _chars, _k in _KINDS:
    _CLASS[list(_chars)] = _k
_SYMBOLS = np.array([0] * 7 + [1] + [0] + [1] * 6 + [0] * 4 + [1, 0, 0, 1, 0], bool)


LABELLERS = ("symbols", "capitals", "repeats", "runs", "pairs", "top_word", "line_ends", "separators", "word_length",
             "stop_words", "marked_words")


def _vote(value: float, good: float, bad: float) -> int:
    """1 at the good end, -1 at the bad end, else 0."""
    if good < bad:
        return 1 if value <= good else -1 if value >= bad else 0
    return 1 if value >= good else -1 if value <= bad else 0


def profile(text: bytes) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Votes of the labellers, and the hashed features (places and values)."""
    cls = _CLASS[np.frombuffer(text, np.uint8)]
    count = np.bincount(cls, minlength=24)
    seq = text.split()
    n = max(1, len(seq))
    tally: dict[bytes, int] = {}
    for w in seq:
        tally[w] = tally.get(w, 0) + 1
    same = [a == b for a, b in zip(seq, seq[1:], strict=False)]
    repeats = sum(same) / n
    thirds = sum(a and b for a, b in zip(same, same[1:], strict=False)) / n
    pairs = len(set(zip(seq, seq[1:], strict=False))) / max(1, len(seq) - 1)
    top = max(tally.values(), default=0) / n
    lines = [x for x in text.split(b"\n") if x.strip()]
    ends = sum(x.rstrip()[-1:] in (b".", b"!", b"?", b":", b'"') for x in lines) / max(1, len(lines))
    letters = max(1, int(count[0] + count[1]))
    symbols = float(count[_SYMBOLS].sum()) / n
    stops = sum(c for w, c in tally.items() if w.lower() in STOP) / n
    marked = sum(c for w, c in tally.items() if len(w) > 2 and not (w[-2:].isalnum() or w[-2] >= 128 or 48 <= w[-2] <= 57
                 or 65 <= w[-2] <= 90 or 97 <= w[-2] <= 122)) / n
    upper, length = float(count[1]) / letters, (letters + float(count[2])) / n
    long = len(seq) >= 20
    votes = [
        _vote(symbols, 0.02, 0.25),
        _vote(upper, 0.2, 0.6) if letters > 10 else 0,
        _vote(repeats, 0.02, 0.15) if len(seq) > 5 else 0,
        _vote(thirds, 0.01, 0.1) if len(seq) > 5 else 0,
        _vote(pairs, 0.7, 0.3) if 20 <= len(seq) <= 2000 else 0,
        _vote(top, 0.15, 0.3) if long else 0,
        _vote(ends, 0.7, 0.1) if len(seq) > 5 else 0,
        -1 if float(count[14]) / n > 0.15 else 0,
        _vote(abs(length - 6.0), 3.0, 9.0),
        _vote(stops, 0.1, 0.02) if long else 0,
        _vote(marked, 0.02, 0.2),
    ]
    # runs of one class count once, so a word is one letter of the shape
    runs = cls[np.flatnonzero(np.diff(cls, prepend=-1))] if len(cls) else cls
    grams = [runs + 100]
    if len(runs) > 1:
        grams.append(runs[:-1] * 32 + runs[1:] + 1000)
    if len(runs) > 2:
        grams.append((runs[:-2] * 32 + runs[1:-1]) * 32 + runs[2:] + 10000)
    shape = np.bincount(np.concatenate(grams) * 2654435761 % (1 << 32) % (DIMS - 64), minlength=DIMS)
    at = np.flatnonzero(shape)
    value = np.sqrt(shape[at] / max(1, len(runs)))
    level = lambda x, k: int(min(7, x * k))
    more = DIMS - 64 + np.array([level(repeats, 16), 8 + level(top, 12), 16 + level(upper, 8), 24 + level(length, 0.5),
                                 32 + level(stops, 20), 40 + level(ends, 7), 48 + level(marked, 16),
                                 56 + level(np.log10(n), 1.5)])
    return votes, np.concatenate([at, more]), np.concatenate([value, np.full(len(more), 0.5)])


PROFILE = T.StructType([
    T.StructField("order", T.LongType()), T.StructField("votes", T.ArrayType(T.IntegerType())),
    T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.FloatType()))])


def _profiles(docs: DataFrame, text: str, features: bool) -> DataFrame:
    def run(batches):
        for batch in small(batches):
            got = [profile(t or b"") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([g[0] for g in got], pa.list_(pa.int32())),
                pa.array([g[1].tolist() if features else [] for g in got], pa.list_(pa.int32())),
                pa.array([g[2].tolist() if features else [] for g in got], pa.list_(pa.float32()))], PROFILE.names)

    order = F.xxhash64(text)  # other columns say nothing
    return docs.select(order, F.col(text).cast("binary")).mapInArrow(run, PROFILE)


def fit(docs: DataFrame, text: str = "text", sample: int = SAMPLE) -> dict | None:
    """The scorer (weights, bias) with the labellers' reliabilities, or None if
    no document has text."""
    docs = docs.where(F.length(text) > 0)
    patterns = _profiles(docs, text, False).groupBy("votes").count().collect()
    total = sum(r["count"] for r in patterns)
    if not total:
        return None
    table, post = reliabilities([(list(r["votes"]), r["count"]) for r in patterns])
    posterior = {tuple(r["votes"]): p for r, p in zip(patterns, post, strict=True)}
    share = int(min(1.0, 1.3 * sample / total + 0.001) * 1_000_000)
    some = docs.where(F.pmod(F.xxhash64(text), F.lit(1_000_000)) < share)
    rows = _profiles(some, text, True).orderBy("order", "votes").limit(sample).collect()
    w, b = train(rows, posterior, DIMS)
    return {"weights": w, "bias": b, "reliabilities": dict(zip(LABELLERS, table.tolist(), strict=True))}


def score(docs: DataFrame, model: dict | None, text: str = "text", out: str = "quality", toxic: str = "toxic",
          abuse: dict | None = None) -> DataFrame:
    """``docs`` with the probability of good in column ``out`` and the toxicity
    verdict of the model ``abuse`` in ``toxic`` (columns of those names give way)."""
    docs = docs.drop(out, toxic)
    if model is None:  # no document has text
        return docs.withColumn(out, F.lit(0.0)).withColumn(toxic, F.lit(False))
    w, b = model["weights"].astype(float), model["bias"]
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.DoubleType()), T.StructField(toxic, T.BooleanType())])
    verdict = toxicity.judge(abuse)

    def run(batches):
        for batch in small(batches):
            p, bad = [], []
            for t in batch.column(batch.schema.names.index(text)).cast(pa.binary()).to_pylist():
                bad.append(verdict(t))
                if not t:
                    p.append(0.0)
                    continue
                _, at, value = profile(t)
                p.append(float(1 / (1 + np.exp(-(w[at] @ value + b)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64()), pa.array(bad, pa.bool_())], schema.names)

    return docs.mapInArrow(run, schema)


def keep_good(docs: DataFrame, text: str = "text", least: float = 0.5, labels: DataFrame | None = None) -> DataFrame:
    """The documents that the scorer accepts and that are not toxic, columns as given.
    ``labels`` (doc_id, toxic) teach what is toxic; without them the lists decide."""
    scored = score(docs, fit(docs, text), text, "__quality", "__toxic", toxicity.fit(docs, labels, text))
    return scored.where((F.col("__quality") >= least) & ~F.col("__toxic")).drop("__quality", "__toxic")


def op8_weak_labels(spark, sf_dir: str) -> DataFrame:
    """Score and decision of quality, and the toxicity verdict, for every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    abuse = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return score(docs, fit(docs), abuse=abuse).select("doc_id", "quality", (F.col("quality") >= 0.5).alias("kept"), "toxic")
