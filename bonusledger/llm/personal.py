"""Personal data by weak supervision, in DataFrame expressions only.

Four base kinds have fixed patterns and checks.  Other candidates (tokens with a
digit, titles with names) get votes from regex, gazetteer and context labelers.
Expectation-maximisation over the counts of all vote patterns (at most 3 to the
number of labelers) estimates the labelers' reliabilities; the posteriors, summed
per hashed feature over all candidates, train the final classifier, a log-linear
model over token shape, length, variety of characters and the word before.  A
candidate with positive log odds is a span beside the base spans.

A text is cut at the matches of a pattern: the lengths of the gaps and matches give
the offsets in code points, so no position is searched twice.  Patterns are
possessive and anchored where a token begins, hence linear also on long texts.
Null texts are empty and have no spans.  Equal texts have equal spans.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import land

# Base kinds in their order, each with a pattern that finds what its
# plain form finds.  A match can begin only at the begin of a run of its first
# characters or right behind the match before, so nothing is tried twice.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
HINT = {"email": "@", "phone": "+"}
# Titles, given names and cue words.
TITLES = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"
NAMES = (
    "anna|antonio|carlos|carmen|charles|claire|david|elena|elizabeth|emma|hans|heinz|james|jean|john|jose|juan|julia|karl|"
    "klaus|laura|luis|maria|marie|mary|michael|michel|monika|paul|peter|petra|pierre|robert|sabine|sarah|sofia|sophie|thomas|ursula|william")
SECRET = "pass(?:word|wd|phrase)?|pwd|secret|token|api[_-]?key|access[_-]?key"
CUES = "ssn|passport|account|iban|konto|licen[cs]e|password|secret|token|key|tel|phone|call|fax|mobile|born|birth|geboren|tax"
PLAIN = "page|chapter|section|version|figure|table|year|line|part|vol|no"
_EDGE = r"\s\"'<>,;()\[\]{}"
CANDIDATE = (
    rf"(?<![\p{{L}}])(?:{TITLES})\.?\x20\p{{Lu}}\p{{L}}++(?:\x20\p{{Lu}}\p{{L}}++)?"
    rf"|(?<![^{_EDGE}])[^0-9{_EDGE}]*+[0-9][^{_EDGE}]*+")
LABELERS = ("secret_shape", "mixed_length", "assignment", "number_shape", "plain_number", "context", "gazetteer", "variety")
BUCKETS = 2048
SPAN = "array<struct<s:int,e:int,o:int,kind:string>>"


def _holds(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern counts."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind == "ip":
        parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    if kind == "card":
        return F.length(digits).between(12, 19) & F.call_function("luhn_check", digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _cut(text: Column, pattern: str) -> Column:
    """The text as (gap, match) pairs; the last match is empty."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return F.zip_with(F.split(text, pattern, -1), F.concat(matches, F.array(F.lit(""))),
                      lambda g, m: F.struct(g.alias("g"), m.alias("m")))


def _guard(kind: str, text: Column, found: Column, otherwise: Column) -> Column:
    some = F.contains(text, F.lit(HINT[kind])) if kind in HINT else text.rlike("[0-9]")
    return F.when(some, found).otherwise(otherwise)


def _none() -> Column:
    return F.array().cast(SPAN)


def _located(pairs: Column, kind, holds, order: int, length=F.length) -> Column:
    """Spans of the matches that hold, by adding up lengths."""

    def step(acc: Column, x: Column) -> Column:
        at = acc["p"] + F.length(x["g"])
        span = F.array(F.struct(at.alias("s"), (at + length(x["m"])).alias("e"), F.lit(order).alias("o"), kind(x).alias("kind")))
        return F.struct((at + F.length(x["m"])).alias("p"),
                        F.when((x["m"] != "") & holds(x), F.concat(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("p"), _none().alias("out"))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def base_spans(text: Column) -> dict[str, Column]:
    return {kind: _guard(kind, text, _located(
        _cut(text, pattern), lambda x, k=kind: F.lit(k), lambda x, k=kind: _holds(k, x["m"]), i), _none())
        for i, (kind, pattern) in enumerate(BASE.items())}


def _token(m: Column) -> Column:
    return F.regexp_replace(m, r"[^\p{L}0-9]+$", "")


def _if(good, bad=None) -> Column:
    out = F.when(good, 1)
    return (out.when(bad, -1) if bad is not None else out).otherwise(0)


def _votes(x: Column) -> Column:
    """Votes of the labelers on a candidate (gap before it, match), as text."""
    m, before = _token(x["m"]), F.lower(F.right(x["g"], F.lit(24)))
    kinds = F.size(F.array_distinct(F.split(m, "")))
    both = m.rlike("[0-9]") & m.rlike(r"\p{L}")
    return F.concat_ws(",", *[v.cast("string") for v in (
        _if(m.rlike(r"^AKIA[0-9A-Z]{16}$|^(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{16,}$|^[0-9a-f]{32,}$")),
        _if((F.length(m) >= 18) & both, F.length(m) <= 6),
        _if(m.rlike(rf"(?i)(?:{SECRET})[=:]."), m.rlike(r"^[0-9]")),
        _if(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$|^[0-9]{3}-[0-9]{3}-[0-9]{4}$")),
        _if(F.lit(False), m.rlike(r"^[#$€£]?[0-9]{1,8}(?:[.,:/][0-9]+)*[%.]?$") | m.rlike(r"^\p{L}?[0-9]{1,3}$")),
        _if(before.rlike(rf"\b(?:{CUES})\b[^\p{{L}}0-9]*$"), before.rlike(rf"\b(?:{PLAIN})\b[^\p{{L}}0-9]*$")),
        _if(m.rlike(rf"(?i)^(?:{TITLES})\.?\x20|\b(?:{NAMES})\b") | m.rlike(rf"(?i)\b(?:{SECRET})\b")),
        _if(kinds >= 11, kinds <= 4))])


def _features(x: Column) -> Column:
    """Hashed features of a candidate, as buckets."""
    m = _token(x["m"])
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(m, "[0-9]+", "0"), r"\p{Ll}+", "a"), r"\p{Lu}+", "A")
    before = F.lower(F.regexp_extract(F.right(x["g"], F.lit(40)), r"(\p{L}+)[^\p{L}]*$", 1))
    lead = F.lower(F.regexp_extract(m, r"^(\p{L}+)", 1))
    size = F.least(F.length(m), F.lit(48)).cast("string")
    kinds = F.size(F.array_distinct(F.split(m, ""))).cast("string")
    hashed = lambda tag, v: F.pmod(F.xxhash64(F.lit(tag), v), F.lit(BUCKETS)).cast("int")
    return F.array(hashed("shape", shape), hashed("before", before), hashed("lead", lead), hashed("size", size),
                   hashed("kinds", kinds))


def _is_other(x: Column) -> Column:
    """A candidate that no base kind stands for."""
    m = _token(x["m"])
    return (m != "") & ~m.rlike(r"@|^\+|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$|^[0-9]{12,19}$")


def _candidates(text: Column) -> Column:
    return F.when(text.rlike(rf"[0-9]|(?:{TITLES})\.?\x20"), _cut(text, CANDIDATE))


def reliabilities(patterns: list[tuple[str, int]], rounds: int = 60) -> dict[str, float]:
    """Posterior of personal data for each vote pattern, by two-class
    expectation-maximisation with one error table per labeler."""
    votes = {p: [int(v) for v in p.split(",")] for p, _ in patterns}
    total = sum(n for _, n in patterns)
    post = {p: 1 / (1 + math.exp(1.0 - 2.0 * sum(v))) for p, v in votes.items()}
    for _ in range(rounds):
        prior = min(0.99, max(0.001, sum(post[p] * n for p, n in patterns) / total))
        chance = []
        for j in range(len(LABELERS)):
            c = [[1.0, 1.0], [1.0, 1.0]]  # class x (vote against, vote for)
            for p, n in patterns:
                v = votes[p][j]
                if v:
                    c[0][v > 0] += n * (1 - post[p])
                    c[1][v > 0] += n * post[p]
            # a labeler is never worse than a coin
            yes, no = c[1][1] / sum(c[1]), c[0][0] / sum(c[0])
            chance.append((max(yes, 0.5), max(no, 0.5)))
        for p, v in votes.items():
            odds = math.log(prior / (1 - prior))
            for (yes, no), x in zip(chance, v, strict=True):
                if x > 0:
                    odds += math.log(yes / (1 - no + 1e-9))
                elif x < 0:
                    odds += math.log((1 - yes + 1e-9) / no)
            post[p] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
    return post


def fit(docs: DataFrame, text: str = "text") -> dict | None:
    """The classifier's bias and weights per bucket; None without candidates."""
    body = F.coalesce(F.col(text), F.lit(""))
    found = docs.select(F.explode(F.filter(_candidates(body), _is_other)).alias("x"))
    found = land(found.select(_votes(F.col("x")).alias("votes"), _features(F.col("x")).alias("at")), "pii")
    patterns = [(r["votes"], r["count"]) for r in found.groupBy("votes").count().collect()]
    if not patterns:
        return None
    post = F.from_json(F.lit(json.dumps(reliabilities(patterns))), "map<string,double>")
    sums = (found.select("at", F.element_at(post, F.col("votes")).alias("p")).select(F.explode("at").alias("at"), "p")
            .groupBy("at").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect())
    yes, no = sum(r["yes"] for r in sums) + BUCKETS, sum(r["no"] for r in sums) + BUCKETS
    weights = [0.0] * BUCKETS
    for r in sums:
        weights[r["at"]] = math.log((r["yes"] + 1) / yes) - math.log((r["no"] + 1) / no)
    # each candidate has one feature of each of five kinds
    prior = math.log(((yes - BUCKETS) / 5 + 0.5) / ((no - BUCKETS) / 5 + 0.5))
    return {"bias": prior, "weights": weights}


def _chosen(model: dict):
    weights = F.from_json(F.lit(json.dumps(model["weights"])), "array<double>")

    def holds(x: Column) -> Column:
        odds = F.aggregate(_features(x), F.lit(float(model["bias"])), lambda s, i: s + F.get(weights, i))
        return _is_other(x) & (odds > 0)

    return holds


def _kind(x: Column) -> Column:
    m = x["m"]
    return (F.when(m.rlike(rf"^(?:{TITLES})\.?\x20"), "person").when(m.rlike(r"^[0-9][0-9-]+[0-9]\.?$"), "number")
            .otherwise("secret"))


def added_spans(text: Column, model: dict | None) -> Column:
    if model is None:
        return _none()
    return F.coalesce(_located(_candidates(text), _kind, _chosen(model), len(BASE), lambda m: F.length(_token(m))), _none())


def _masked(kind: str):
    return lambda x: F.concat(
        x["g"], F.when((x["m"] != "") & _holds(kind, x["m"]), f"[{kind.upper()}]").otherwise(x["m"]))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the spans in ``text`` replaced by the kind in brackets."""
    model = fit(docs, text)
    out = docs
    for kind, pattern in BASE.items():
        t = F.col(text)
        out = out.withColumn(text, _guard(kind, t, F.array_join(F.transform(_cut(t, pattern), _masked(kind)), ""), t))
    if model is not None:
        holds, t = _chosen(model), F.col(text)
        parts = F.transform(_candidates(t), lambda x: F.concat(
            x["g"], F.when(holds(x), F.concat(F.lit("["), F.upper(_kind(x)), F.lit("]"), F.substr(x["m"], F.length(_token(x["m"])) + 1)))
            .otherwise(x["m"])))
        out = out.withColumn(text, F.coalesce(F.array_join(parts, ""), t))
    return out


def _listed(spans: Column) -> Column:
    ordered = F.array_sort(spans)
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def op6_weak_supervision(spark, sf_dir: str) -> DataFrame:
    """Counts and places of personal data in every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs)
    text = F.coalesce(F.col("text"), F.lit(""))
    found = docs.select("doc_id", *[c.alias(k) for k, c in base_spans(text).items()], added_spans(text, model).alias("more"))
    # spans sort by start, then by the order of their kinds
    key = lambda c: F.transform(c, lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e"), x["kind"].alias("kind")))
    base = F.concat(*[key(F.col(k)) for k in BASE])
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(_listed(base).cast("binary"), 256).alias("base_sha256"),
        _listed(F.concat(base, key(F.col("more")))).alias("spans"))
