"""Toxic documents from weak labels.

Words that go with toxicity are learned from labelled rows: word stems (their first
4 to 7 bytes, and whole words) that stand in many more places of toxic rows than of
others, a place being the word before, so copies and passages count once.  At most ``LABELLED`` labelled rows of each kind are read for that.  Labellers then vote
toxic, clean or abstain on every document: the lists of insults and slurs,
and share, number and spread of learned stems.  Expectation-maximisation
over the counts of all vote patterns estimates the labellers' reliabilities; the
posteriors of a bounded sample train a hashed linear scorer over stems and votes,
which decides on every document, whole text.

Without labelled toxic rows no stem is learned and the lists alone decide.  Null and
empty texts are not toxic.  A labelled id without a document, and a document without a
label, count for nothing; rows with a null label are left out.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import land, small
from .weak import reliabilities, train

LABELLED = 2000  # labelled rows of each kind that stems are learned from, at most
SAMPLE = 6000  # documents of each side of the posterior that the scorer is trained on, at most
PLACES, ODDS = 8, 3.0  # different words that a stem follows in toxic rows at least, and its log odds
SHARE, CLEAN = 0.012, 0.004  # learned log odds a word from which a text seems toxic, up to which it seems clean
DIMS = 1024
HELD = 50_000  # stems that a task holds before it gives them on
LABELLERS = ("insults", "slurs", "stem_share", "stem_count", "stem_spread")


# Insults of four languages.  Words that also have a harmless use
# (trash) or a harmless twin in another of the languages (con, bete) count only
# where the text has another one, or are left out.
SLURS = (
    "asshole assholes bastard bastards bitch bitches bullshit cunt cunts dickhead dipshit dumbass dumbfuck fag faggot faggots "
    "fucker fuckers fucking fuckwit imbecile imbeciles jackass kike motherfucker motherfuckers nigger niggers paki pisshead prick "
    "retard retarded retards scumbag scumbags shithead slut sluts spic subhuman tranny twat twats wanker wankers whore whores "
    "arschloch arschlöcher dreckskerl dreckskerle dreckssau dummkopf fotze hackfresse hurensohn hurensöhne kanake kanaken "
    "miststück missgeburt schlampe schlampen schwachkopf schwuchtel schwuchteln spasti untermensch untermenschen vollidiot "
    "vollidioten vollpfosten vollspast wichser "
    "bougnoule bougnoules connard connards connasse connasses crétin crétins encule enculé enculés enfoiré enfoirés pouffiasse "
    "pédé pédés salaud salauds salopard salopards salope salopes trouduc youpin "
    "cabrón cabrones gilipollas hijoputa hijueputa imbécil imbéciles malnacido malparido maricón maricones mierdoso pendejo "
    "pendejos putas soplapollas subnormal subnormales sudaca sudacas zorras").split()
INSULTS = (
    "abomination clown clowns coward cowards creep creeps cretin cretins crybaby degenerate degenerates deplorable disgusting "
    "dumb fatso filth filthy fool fools freak freaks garbage halfwit hideous idiot idiotic idiots ignoramus jerk jerks lame "
    "laughable loathsome loser losers lowlife lunatic maggot maggots moron moronic morons nitwit parasite parasites pathetic "
    "pig pigs psycho repulsive revolting scum shit shitty sicko simpleton stupid stupidity suck sucks swine trash ugly vermin "
    "vile weirdo worthless wretch "
    "abschaum armselig bekloppt blödmann depp deppen drecksack dumm dumme dummer ekelhaft erbärmlich feigling gesindel "
    "hirnlos idioten idiotin lächerlich nichtsnutz pack penner scheiße scheiss schwein schweine trottel ungeziefer verlierer "
    "versager wertlos widerlich "
    "abruti abrutie abrutis bouffon bouffons débile débiles dégoûtant dégoûtante idiote idiotes lamentable merde minable "
    "minables ordure ordures pitoyable pourriture raclure répugnant stupide stupides vermine "
    "asqueroso asquerosa basura cobarde cobardes despreciable escoria estúpida estúpidas estúpido estúpidos fracasado "
    "fracasados idiotas inútil inútiles mierda miserable patético patética payaso payasos repugnante tonto tontos").split()


def _spelt(listed: list[str]) -> frozenset:
    """The words as bytes whose A-Z are lower-cased, also of capitals and of split accents."""
    forms = {f(w) for w in listed for f in (str, str.upper, str.capitalize)}
    return frozenset(unicodedata.normalize(k, w).encode().lower() for w in forms for k in ("NFC", "NFD"))


SLUR_FORMS, INSULT_FORMS = _spelt(SLURS), _spelt(SLURS + INSULTS)
_LETTERS = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
_QUOTES = re.compile(rb"\xe2\x80[\x80-\xbf]|\xc2[\xa0-\xbf]|\xe3\x80[\x80-\xbf]")
TOXIC_SHARE = 0.004  # of the words, from two insults on


def letters(text: bytes | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased."""
    return _QUOTES.sub(b" ", (text or b"").lower()).translate(_LETTERS).split()


def insulting(seq: list[bytes], hits: list[bytes]) -> bool:
    return len(hits) > 1 and len(hits) >= TOXIC_SHARE * len(seq)


def is_toxic(text: bytes | None) -> bool:
    """Whether insults make up ``TOXIC_SHARE`` of the words and are two at least, or
    a slur is one word of a hundred or fewer."""
    seq = letters(text)
    hits = [w for w in seq if w in INSULT_FORMS]
    return insulting(seq, hits) or len(hits) == 1 and len(seq) <= 100 and hits[0] in SLUR_FORMS


def bucket(data: bytes) -> int:
    return xxhash.xxh3_64_intdigest(data) >> 1


def stems(words) -> set[bytes]:
    """First 4 to 7 bytes of the words, and the words as a whole (with an end mark)."""
    out = set()
    for w in words:
        if len(w) > 3:
            out.update(w[:k] for k in range(4, min(8, len(w) + 1)))
            out.add(w + b"$")
    return out


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic",
          rows: int = LABELLED) -> dict[bytes, float]:
    """Log odds of the stems that go with toxic rows."""
    given = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        F.col(key).alias("k"), (F.col(label) > 0).alias("bad")).distinct()
    order = [F.xxhash64("k"), F.col("k")]
    some = land(given.where("bad").orderBy(*order).limit(rows).union(given.where("not bad").orderBy(*order).limit(rows)), "toxic-labels")
    texts = docs.select(F.col(key).alias("k"), F.col(text).cast("binary").alias("t")).join(F.broadcast(some), "k").select("bad", "t")

    def run(batches):
        seen: set[tuple[bytes, int, bool]] = set()
        got: list[tuple[bytes, int, bool, int]] = []
        for batch in small(batches):
            for bad, t in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                doc, seq = bucket(t or b""), letters(t)
                for before, w in zip([b"", *seq], seq, strict=False):
                    place = bucket(before)
                    for s, at in [(b"", bucket(before + b" " + w)), *((s, place) for s in stems([w]))]:
                        if (s, at, bad) not in seen:
                            seen.add((s, at, bad))
                            got.append((s, at, bad, doc))
                    if len(got) > HELD:
                        yield pack(got)
                        got.clear()
                        seen.clear()
        if got:
            yield pack(got)

    def pack(got):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(
            zip(*got, strict=True), (pa.binary(), pa.int64(), pa.bool_(), pa.int64()), strict=True)], ["stem", "place", "bad", "doc"])

    # a stem counts once per word before it, so copies and shared passages count once
    places = texts.mapInArrow(run, "stem binary, place long, bad boolean, doc long").groupBy("stem", "place", "bad").agg(F.min("doc").alias("doc"))
    bad_doc = F.when(F.col("bad"), F.col("doc"))
    counts = land(places.groupBy("stem").agg(
        F.count_if("bad").alias("a"), F.count_if(~F.col("bad")).alias("b"), (F.min(bad_doc) < F.max(bad_doc)).alias("several")), "toxic-stems")
    n1, n0 = counts.where("stem = X''").select("a", "b").first() or (0, 0)
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 2.0) / (n0 + 1))
    found = counts.where(f"a >= {PLACES} and several and stem != X''").select("stem", odds.alias("odds")).where(F.col("odds") > ODDS)
    return {bytes(r["stem"]): r["odds"] for r in found.orderBy("stem").collect()}  # bounded by the labelled rows


class Reader:
    """Votes (1 clean, -1 toxic, 0 none) and hashed features of a text."""

    def __init__(self, odds: dict[bytes, float]):
        self.odds = odds
        self.heads = {s[:4] for s in odds}

    def __call__(self, text: bytes | None) -> tuple[list[int], list[int], list[float]]:
        seq = letters(text)
        hits = [w for w in seq if w in INSULT_FORMS]
        n = max(1, len(seq))
        found: Counter = Counter()
        words = 0
        for w, c in Counter(w for w in seq if w[:4] in self.heads).items():
            got = [s for s in stems([w]) if s in self.odds]
            words += bool(got)
            for s in got:
                found[s] += c
        share = sum(self.odds[s] * c for s, c in found.items()) / n
        count = sum(found.values())
        known = bool(self.odds) and bool(seq)
        votes = [
            -1 if insulting(seq, hits) else 0 if hits else 1,
            -1 if len(hits) == 1 and len(seq) <= 100 and hits[0] in SLUR_FORMS else 0,
            (-1 if share >= SHARE else 1 if share <= CLEAN else 0) if known else 0,
            (-1 if count >= 6 else 1 if count <= 1 else 0) if known else 0,
            (-1 if words >= 3 else 1 if words <= 1 else 0) if known else 0,
        ]
        at, value = [], []
        places: dict[int, float] = {}
        for s, c in found.items():
            place = bucket(s) % (DIMS - 32)
            places[place] = places.get(place, 0.0) + c / n
        for place, x in sorted(places.items()):
            at.append(place)
            value.append(float(min(1.0, 10 * x)))
        for j, v in enumerate(votes):
            at.append(DIMS - 32 + 3 * j + v + 1)
            value.append(1.0)
        at.append(DIMS - 1 - int(min(7, share * 250)))
        value.append(1.0)
        return votes, at, value


def fit(docs: DataFrame, labels: DataFrame | None, text: str = "text", key: str = "doc_id", sample: int = SAMPLE) -> dict | None:
    """Stems, reliabilities and scorer; None if nothing can be learned."""
    odds = learn(docs, labels, text, key) if labels is not None else {}
    if not odds:
        return None

    def run(batches):
        read = Reader(odds)
        for batch in small(batches):
            got = [read(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([
                pa.array([bucket(t or b"") for t in batch.column(0).to_pylist()], pa.int64()),
                pa.array([g[0] for g in got], pa.list_(pa.int32())), pa.array([g[1] for g in got], pa.list_(pa.int32())),
                pa.array([g[2] for g in got], pa.list_(pa.float32()))], ["order", "votes", "at", "value"])

    seen = land(docs.where(F.length(text) > 0).select(F.col(text).cast("binary")).mapInArrow(
        run, "order long, votes array<int>, at array<int>, value array<float>"), "toxic-votes")
    patterns = seen.groupBy("votes").count().collect()  # at most 3 to the number of labellers
    if not patterns:
        return None
    table, post = reliabilities([(list(r["votes"]), r["count"]) for r in patterns])
    posterior = {tuple(r["votes"]): 1 - p for r, p in zip(patterns, post, strict=True)}
    sides = {True: [], False: []}
    for r in patterns:
        sides[posterior[tuple(r["votes"])] >= 0.5].append(tuple(r["votes"]))
    rows = []
    for side in sides.values():
        if side:
            here = F.array_join("votes", ",").isin([",".join(map(str, v)) for v in side])
            rows += seen.where(here).orderBy("order", "votes").limit(sample).collect()
    w, b = train(rows, posterior, DIMS)
    # both classes weigh the same in training; the share of toxic documents comes back here
    total = sum(r["count"] for r in patterns)
    prior = float(np.clip(sum(r["count"] * posterior[tuple(r["votes"])] for r in patterns) / total, 0.001, 0.5))
    b += float(np.log(prior / (1 - prior)))
    return {"odds": odds, "weights": w, "bias": b, "reliabilities": dict(zip(LABELLERS, table.tolist(), strict=True))}


def judge(model: dict | None):
    """text -> whether it is toxic, by the scorer; by the lists without one."""
    if model is None:
        return is_toxic
    read, w, b = Reader(model["odds"]), model["weights"].astype(float), model["bias"]

    def toxic(text: bytes | None) -> bool:
        if not text:
            return False
        _, at, value = read(text)
        return bool(w[at] @ np.array(value) + b >= 0)

    return toxic
