"""Token counts, conversation repair and vector codes against plain Python, with
nulls, ties, repeated rows, empty tables and rows of one hot group."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from math import floor

import pyarrow as pa
import pytest
import sentencepiece
from conftest import SF_SMALL
from pyspark.sql import functions as F

from bonusledger.llm import conversations, token_counts, vector_codes

from .conftest import LONG, rows_of

# ---------- token counts

ODD = ["", " ", "  ", "a", "▁", "▁▁a ▁", "<s> </s> <unk> <0x41>", "x²..", "½.a", "日本語テキスト", "😀😀 é", "\x00a\x00",
       "a\nb\t\tc\r\n", "    code  = 1;\n\n        return x_1__2\n", "a" * 5000, " " * 777, "ab" * 3000 + "  .", "Ⅷ.",
       "10.5e10,3", "é" * 40, "٣٤a", "ábc", "don't", "x" + " " * 40 + "y", "x" * 65, "in" * 33 + " ", LONG]


def odd_texts():
    r = random.Random(1)
    return ODD + ["".join(r.choice("ab e.,▁ \n²½é日1_") for _ in range(r.randint(1, 90))) for _ in range(1500)]


def test_token_counts_are_the_library_s(spark, save):
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.piece_path())
    texts = [*odd_texts(), None, "same", "same"]
    d = save("documents", [(None if i == 3 else i % 1500, t, "x", 7) for i, t in enumerate(texts)],
             "doc_id long, text string, n_tokens string, limit int")
    got = sorted(map(tuple, token_counts.op11_whole_tokens(spark, d).collect()), key=str)
    want = sorted([(None if i == 3 else i % 1500, len((t or "").encode()), n := len(sp.encode(t or "")), n > 4096)
                   for i, t in enumerate(texts)], key=str)
    assert got == want
    assert rows_of(token_counts.op11_whole_tokens(spark, save("documents", [], "doc_id long, text string"))) == []


def test_token_counts_of_all_documents(spark):
    sp = sentencepiece.SentencePieceProcessor(model_file=token_counts.piece_path())
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.op11_whole_tokens(spark, SF_SMALL).collect()}
    assert got == {i: len(sp.encode(t)) for i, t in texts.items()}


def test_cache_and_long_texts_do_not_change_counts(monkeypatch):
    with open(token_counts.piece_path(), "rb") as f:
        model = token_counts.compile_model(f.read())
    plain = [token_counts.Counter(model).count(t) for t in odd_texts()]
    monkeypatch.setattr(token_counts, "_CACHE", 5)
    monkeypatch.setattr(token_counts, "_AT_ONCE", 3)
    counter = token_counts.Counter(model)
    assert [counter.count(t) for t in odd_texts()] == plain


def test_whole_tokens_need_their_proof():
    """A piece that merges never make, since an earlier merge takes its middle, is
    no whole token; a piece over a cut makes the cuts coarser."""
    costs = {"a": 9.0, "b": 9.0, "c": 9.0, "d": 9.0, "bc": 1.0, "ab": 2.0, "abcd": 6.0, "cd": 3.0, "abd": 7.0}
    whole = set(token_counts.whole_tokens(costs, token_counts.cutter(costs)))
    assert {"bc", "cd", "abd"} <= whole and "abcd" not in whole
    for p in costs:
        assert (token_counts.merged(p, costs) == [p]) == (p in whole)
    assert "[^\\W" in token_counts.cutter(costs)
    assert "[^\\W" not in token_counts.cutter(costs | {"a.": 4.0})
    assert token_counts.cutter(costs | {"a▁b": 4.0}) == "(?s:.+)"
    r = random.Random(5)
    for _ in range(300):
        text = "".join(r.choice("abcd") for _ in range(r.randint(60, 200)))
        assert token_counts._merged_long(text[:64], costs) == token_counts.merged(text[:64], costs)


# ---------- conversation repair

WHITE = " \t\n\x0b\x0c\r"
ROLES = {"s": "system", "u": "user", "a": "assistant", "o": "tool"}


def best_edits(rows):
    """(cost, audit) by a DP over single rows that carries whole audits; rows are
    (initial, blank or duplicate, truncated)."""
    after_insert, states = {0: 2, 1: 2, 2: 3, 3: 2}, {0: (0, "")}

    def inserted(states):
        todo = list(states)
        while todo:
            s = todo.pop()
            new = (states[s][0] + 3, states[s][1] + "I")
            if after_insert[s] not in states or new < states[after_insert[s]]:
                states[after_insert[s]] = new
                todo.append(after_insert[s])
        return states

    for initial, gone, late in rows:
        new = {}
        for s, (cost, audit) in inserted(states).items():
            moves = [(s, 4, "D")]
            if not gone:
                moves.append((after_insert[s], 3 + 3 * late, "R"))
                kept = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(initial)
                moves += [(kept, 3 * late, "K")] if kept else []
            for t, more, letter in moves:
                way = (cost + more, audit + letter)
                new[t] = min(new.get(t, way), way)
        states = new
    return min(v for s, v in inserted(states).items() if s in (0, 3))


def plain_repair(rows):
    """The contract on rows (turn, role, text) after damage, in order."""
    seen, marks, count = set(), [], dict.fromkeys(["blank", "duplicate", "truncated"], 0)
    for _, role, text in rows:
        kept = text.strip(WHITE)
        fault = "blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        marks.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = best_edits(marks)
    turns = [t for t, _, _ in rows if t is not None]
    out, i = [], 0
    for letter in audit:
        if letter == "K":
            out.append(f"{rows[i][1]}:{rows[i][2]}")
        elif letter in "RI":
            role = "user" if not out or out[-1][0] in "sa" else "assistant"
            out.append(f"{role}:{rows[i][2] if letter == 'R' else ''}")
        i += letter != "I"
    assert re.fullmatch("(s?(ua)+)?", "".join(o[0] for o in out))
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **count,
            "illegal": sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(marks, marks[1:])), "cost": cost,
            "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def plain_query(rows):
    """The contract on undamaged rows (conv, turn, role, text)."""
    convs = {}
    for conv, turn, role, text in rows:
        got = convs.setdefault(conv, [])
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        how, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
        got += [(turn, "user" if how == 4 else role, text)] * {0: 0, 3: 2}.get(how, 1)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return sorted(({"conv_id": c} | plain_repair(sorted(r, key=key)) for c, r in convs.items()), key=str)


CONV = "conv_id long, turn long, role string, text string, chunk int, cost string, lines string"


def talk(seed, convs, hot=0):
    r = random.Random(seed)
    texts = ["Yes.", "No", " ", "", "Is it?", "a\nb!", "é…", "ok. ", None, "Tell me more", "x" * 70 + "a.", "x" * 70 + "b."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "assistant"]
    out = []
    for c in range(convs):
        for t in range(r.randint(1, 9)):
            turn = None if r.random() < 0.05 else t * r.choice([1, 1, 2]) - r.choice([0, 0, 3])
            out.append((None if c == 5 else c, turn, r.choice(roles), r.choice(texts)))
    out += r.choices(out, k=convs // 3)
    for t in range(hot):
        role = "user" if t % 2 == 0 else "assistant"
        out.append((convs // 2, t // 2, role if r.random() < 0.8 else r.choice(roles),
                    r.choice(texts) if r.random() < 0.3 else f"{role} {t} says."))
    return out + [(convs // 3, None, "user", "Again.")] * hot


def answer(df):
    return sorted(rows_of(df), key=str)


@pytest.fixture
def many_ranges(spark):
    """Small ranges stay apart."""
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(name)
    spark.conf.set(name, "false")
    yield
    spark.conf.set(name, old)


@pytest.mark.parametrize("seed,convs,hot", [(1, 150, 0), (2, 30, 900)])
def test_conversations_are_repaired(spark, save, many_ranges, seed, convs, hot):
    """With a hot conversation over many ranges, and 900 rows that are equal."""
    rows = talk(seed, convs, hot)
    d = save("conversations", [(*r, 1, "c", "l") for r in rows], CONV)
    assert answer(conversations.op12_run_length(spark, d)) == plain_query(rows)


def test_hot_conversation_is_in_pieces(spark, many_ranges):
    rows = [r for r in talk(4, 4, 600) if r[0] is not None]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = conversations.repair(df.repartition(7)).collect()
    mine = [p for p in pieces if p["conv_id"] == 2]
    assert len(mine) > 2 and {p["n_pieces"] for p in mine} == {len(mine)}
    want = next(w for w in plain_of(rows) if w["conv_id"] == 2)
    mine.sort(key=lambda p: p["piece"])
    assert "".join(p["audit"] for p in mine) == want["audit"] and mine[0]["cost"] == want["cost"]


def plain_of(rows):
    """The contract without damage."""
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return [{"conv_id": c} | plain_repair(sorted(r, key=key)) for c, r in convs.items()]


def test_conversations_of_the_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
            .select("conv_id", "turn", "role", "text").collect()]
    assert answer(conversations.op12_run_length(spark, SF_SMALL)) == plain_query(rows)


def test_conversations_without_rows(spark, save):
    gone = next(i for i in range(100) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    d = save("conversations", [(gone, 1, "user", "Hi.", 1, "", "")], CONV)
    assert answer(conversations.op12_run_length(spark, d)) == [
        {"conv_id": gone, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
         "repaired_sha256": hashlib.sha256(b"").hexdigest()}]
    assert answer(conversations.op12_run_length(spark, save("conversations", [], CONV))) == []


def test_runs_of_any_length():
    """Runs through powers of the matrix give what single rows give."""
    r = random.Random(3)
    for _ in range(1500):
        rows = []
        for _ in range(r.randint(0, 6)):
            gone, late = r.choice([(False, False), (False, False), (False, True), (True, False)])
            rows += [(r.choice("suao"), gone, late)] * r.choice([1, 1, 1, 2, 3, 9, 21])
        runs = []
        for initial, gone, late in rows:
            sym = 0 if gone else conversations.symbol(initial, late)
            if runs and runs[-1][0] == sym:
                runs[-1] = (sym, runs[-1][1] + 1)
            else:
                runs.append((sym, 1))
        assert conversations.solve(runs)[:2] == best_edits(rows)
    cost, audit, _ = conversations.solve([(2, 10**5), (3, 1), (0, 10**5)])
    assert len(audit.replace("I", "")) == 2 * 10**5 + 1 and audit.endswith("D" * 10**5)
    assert cost == sum({"K": 0, "R": 3, "D": 4, "I": 3}[c] for c in audit)


# ---------- vector codes

EMBED = "vec_id long, embedding array<double>, label int, code int, l string, t int"


def plain_codes(rows, parts=4, entries=256, rounds=4):
    """The contract in Python integers on (id, vector, label)."""
    bad = ("nan", "inf", "-inf")
    rows = [r for r in rows if r[1] is not None and all(x is not None and str(x) not in bad for x in r[1])]
    dim = -(-max((len(r[1]) for r in rows), default=0) // parts) * parts
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vectors = [[floor(Fraction(x) * 1024) for x in r[1]] + [0] * (dim - len(r[1])) for r in rows]
    w = dim // parts
    cut = [[tuple(v[p * w:(p + 1) * w]) for v in vectors] for p in range(parts)]
    books = [list(c[:entries]) for c in cut]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for x in cut[p]:
                groups.setdefault(nearest(x, books[p])[1], []).append(x)
            for i, g in groups.items():
                books[p][i] = tuple(sum(c) // len(g) for c in zip(*g))
    found = [[nearest(cut[p][i], books[p]) for p in range(parts)] for i in range(len(rows))]
    errors = [sum(d for d, _ in f) for f in found]
    labels = {}
    for r, e in zip(rows, errors):
        labels[r[2]] = labels.get(r[2], 0) + e
    fit = lambda e: e if e < 2**63 else None
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(({"vec_id": r[0], "code": "".join(f"{i:02x}" for _, i in f), "error": fit(e),
                    "label_error": fit(labels[r[2]]), "codebooks_sha256": sha} for r, f, e in zip(rows, found, errors)), key=str)


def vectors(seed, n, dim=8):
    r = random.Random(seed)
    out = [(i, [r.gauss(0, 0.2) for _ in range(dim)], r.choice([1, 1, 1, 2, 3, None])) for i in range(n)]
    out += [(n + i, out[i % 7][1], 4) for i in range(40)]  # copies
    out += [(n + 50, None, 1), (n + 51, [None] * dim, 1), (n + 52, [float("nan")] * dim, 1),
            (n + 53, [float("inf")] + [0.0] * (dim - 1), 1), (n + 54, [0.0] * dim, 2), (None, [0.1] * dim, 3), (3, [0.2] * dim, 3),
            (3, [0.2] * dim, 3)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("rows", [
    vectors(1, 330), vectors(2, 40, 6), vectors(3, 20, 0)[:20], vectors(4, 30) + [(900, [0.5, -0.25], 9), (901, [], 9)],
    vectors(5, 30) + [(902, [1e200, -1e200, 3.0, 1e-300, 0.0, 0.0, 0.0, 2.0**60], 9)],
    [(i, [0.25, 0.5, 0.0, -1.0], 1) for i in range(300)],
], ids=["entries", "dimension", "no dimension", "lengths", "huge", "equal"])
def test_vector_codes(spark, save, rows):
    d = save("embeddings", [(*r, 5, "l", 6) for r in rows], EMBED)
    assert sorted(rows_of(vector_codes.op13_gnat(spark, d)), key=str) == plain_codes(rows)


def test_vector_codes_of_the_small_table(spark):
    df = spark.read.parquet(f"{SF_SMALL}/embeddings.parquet")
    rows = [tuple(r) for r in df.select("vec_id", F.col("embedding").cast("array<double>"), "label").collect()]
    assert sorted(rows_of(vector_codes.op13_gnat(spark, SF_SMALL)), key=str) == plain_codes(rows)


def test_vector_codes_of_an_empty_table(spark, save):
    assert rows_of(vector_codes.op13_gnat(spark, save("embeddings", [], EMBED))) == []


def test_tree_leaves_out_subtrees_and_no_tie():
    """On clustered entries most distances are not computed; a grid has many ties."""
    import numpy as np

    r = np.random.default_rng(1)
    entries = (r.normal(0, 0.01, (256, 16)) + r.normal(0, 2, (8, 16))[np.arange(256) % 8])
    queries = (r.normal(0, 0.01, (2000, 16)) + entries[r.integers(0, 256, 2000)])
    grid = np.array([[a, b] for a in range(16) for b in range(16)], float) * 2
    for e, q in [(entries, queries), (grid / 1024, r.integers(0, 31, (2000, 2)) / 1024)]:
        dim = e.shape[1]
        e, q = (vector_codes.integers(pa.array(x.tolist()), dim) for x in (e, q))
        book = vector_codes.Codebook(e)
        at, best = book.nearest(q)
        d2 = vector_codes.squares(q, e)
        assert (at == d2.argmin(1)).all() and (best == d2.min(1)).all()
        assert book.looked[0] < 0.5 * d2.size
