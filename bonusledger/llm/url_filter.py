"""URL verdicts: listed rules first, else naive Bayes over segmented words.

Host labels and path parts are cut at characters that are no letters or digits;
each piece is split into words by a unigram Viterbi search whose word counts come
from the pieces of all urls, the words of all page titles and a seed lexicon.  The
searched substrings of distinct pieces are joined with the counts, so there is no
vocabulary to send.  A multinomial naive Bayes scores the words: its classes are
weakly labelled by the seed lexicon (a url with a word of it is a block example),
counted over all urls, so words that go with listed ones weigh too.

A url that is null or has no ``://`` has an empty host and path and is allowed.
Repeated urls get the same verdict.
"""

from __future__ import annotations

import math
import string

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, small

# The rules as (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
# Words of unwanted sites, the weak label of the block class.
SEEDS = ("adult", "ads", "bet", "bets", "casino", "cheap", "escort", "farm", "gambling", "jackpot", "lottery", "loan",
         "pills", "poker", "porn", "sex", "slots", "spam", "track", "viagra", "warez", "win", "xxx")
LONGEST = 24  # characters of a word at most
SEED_COUNT = 20  # times that a seed word counts as seen


def split_url(url: str = "url") -> tuple:
    """Host and path as columns."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def rule_of(host: str, path: str, rules=RULES):
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    out = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(p))
        out = (F.when if out is None else out.when)(
            fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return out


def _pieces(col) -> F.Column:
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def segments(pieces: DataFrame, words: DataFrame) -> DataFrame:
    """(piece, words): each distinct piece split by the unigram Viterbi search.
    ``words`` has (word, n).  Characters that no word covers stand alone."""
    total = float(words.agg(F.sum("n")).first()[0] or 1)
    parts = pieces.select("piece", F.explode(F.sequence(F.lit(0), F.length("piece") - 1)).alias("i")).select(
        "piece", "i", F.explode(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.length("piece") - F.col("i")))).alias("k"))
    parts = parts.withColumn("word", F.substring("piece", F.col("i") + 1, F.col("k")))
    hits = parts.join(words, "word").groupBy("piece").agg(F.collect_list(F.struct("i", "k", "n")).alias("hits"))
    unseen = math.log(total) + 5.0

    def viterbi(batches):
        for batch in small(batches):
            out = []
            for piece, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n = len(piece)
                best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
                arcs: dict[int, list] = {}
                for h in found or []:
                    arcs.setdefault(h["i"], []).append((h["k"], math.log(total / h["n"])))
                for i in range(n):
                    for k, cost in sorted(arcs.get(i, [])) + [(1, unseen)]:
                        if best[i] + cost < best[i + k]:
                            best[i + k], back[i + k] = best[i] + cost, i
                cut = []
                while n:
                    cut.append(piece[back[n]:n])
                    n = back[n]
                out.append(cut[::-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["piece", "words"])

    return pieces.join(hits, "piece", "left").select("piece", "hits").mapInArrow(viterbi, "piece string, words array<string>")


def judge(pages: DataFrame, rules=RULES, seeds=SEEDS, page_id: str = "page_id", url: str = "url",
          html: str | None = "html") -> DataFrame:
    """page_id, host, path, rule, verdict and the log odds of block."""
    spark = pages.sparkSession
    host, path = split_url(url)
    rows = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    # one row per distinct host and path: what many pages share is split and scored once
    names = land(rows.groupBy("host", "path").agg(F.count("*").alias("pages")), "urls")
    texts = names.select(F.explode(F.concat(_pieces(F.col("host")), _pieces(F.col("path")))).alias("word"), "pages")
    counts = texts.groupBy("word").agg(F.sum("pages").alias("n"))
    if html:
        title = F.regexp_extract(F.col(html), r"(?is)<title[^>]*>([^<]*)", 1)
        counts = counts.union(pages.select(F.explode(_pieces(title)).alias("word")).groupBy("word").agg(F.count("*").alias("n")))
    lexicon = spark.createDataFrame([(w, SEED_COUNT) for w in seeds], "word string, n long")
    counts = counts.union(lexicon).where(f"length(word) <= {LONGEST} and (length(word) > 1 or word in ('a', 'i'))")
    words = land(counts.groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    # a piece seen whole as one url token is not evidence that it is one word
    own = texts.groupBy("word").agg(F.sum("pages").alias("own"))
    words = words.join(own, "word", "left").select(
        "word", F.when(F.col("word").isin(*seeds), F.col("n")).otherwise(F.greatest(F.col("n") - F.coalesce("own", F.lit(0)), F.lit(1))).alias("n"))
    words = land(words, "url-words")
    pieces = names.select(F.explode(F.concat(_pieces(F.col("host")), _pieces(F.col("path")))).alias("piece")).distinct()
    split = land(segments(pieces, words), "url-segments")
    tokens = names.select("host", "path", "pages", F.posexplode(F.concat(_pieces(F.col("host")), _pieces(F.col("path")))).alias("at", "piece"))
    tokens = tokens.join(split, "piece").select("host", "path", "pages", F.explode("words").alias("word"))
    tokens = tokens.withColumn("word", F.when(F.col("word").rlike(r"^\p{N}+$"), F.lit("0")).otherwise(F.col("word")))
    tokens = land(tokens.groupBy("host", "path", "word").agg(F.first("pages").alias("pages"), F.count("*").alias("times")), "url-tokens")
    bad = tokens.groupBy("host", "path").agg(F.max(F.col("word").isin(*seeds)).alias("bad"))
    by_word = tokens.join(bad, ["host", "path"]).groupBy("word").agg(
        F.sum(F.when(F.col("bad"), F.col("pages") * F.col("times")).otherwise(0)).alias("b"),
        F.sum(F.when(~F.col("bad"), F.col("pages") * F.col("times")).otherwise(0)).alias("a"))
    by_word = land(by_word, "url-counts")
    b, a, v = by_word.agg(F.sum("b"), F.sum("a"), F.count("*")).first()
    prior = names.join(bad, ["host", "path"], "left").agg(
        F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0)), F.sum("pages")).first()
    odds = math.log(((prior[0] or 0) + 1) / ((prior[1] or 0) - (prior[0] or 0) + 1))
    weight = F.log((F.col("b") + 1) / F.lit((b or 0) + v + 1)) - F.log((F.col("a") + 1) / F.lit((a or 0) + v + 1))
    weights = land(by_word.select("word", weight.alias("w")), "url-weights")
    scores = tokens.join(weights, "word").groupBy("host", "path").agg((F.sum(F.col("w") * F.col("times")) + odds).alias("odds"))
    judged = names.select("host", "path").join(scores, ["host", "path"], "left").withColumn("hit", rule_of("host", "path", rules))
    return rows.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("hit.rule").alias("rule"),
        F.coalesce("hit.verdict", F.when(F.col("odds") > 0, "block").otherwise("allow")).alias("verdict"), "odds")


def op3_segmented_bayes(spark, sf_dir: str) -> DataFrame:
    """A verdict for the url of every page."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("odds")
