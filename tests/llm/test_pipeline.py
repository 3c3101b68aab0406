"""The pipeline on a small fixture against what each stage has to do."""

import pytest

import corpus_pipeline
from bonusledger.llm import pieces

from .conftest import rows_of
from .test_documents import brute_matches, brute_near, brute_personal, prose


def test_pipeline(spark, save):
    plain = [prose(i, 60).capitalize() + "." for i in range(40)]
    passage = prose(900, 30)
    texts = [*plain, "### $$$ !!! %%% &&& " * 30, "You idiot, you pathetic clown. " + plain[3], None, "",
             plain[5].replace(plain[5].split()[30], "edit", 1), plain[6], prose(901, 60) + " " + passage, passage,
             prose(902, 60) + " a@b.example 10.0.0.1 ▁x", "é😀 " + prose(903, 50)]
    save("benchmark", [(1, passage), (2, None)], "item_id long, text string")
    save("labels", [(0, 1, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    d = save("documents", [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)],
             "doc_id long, text string, lang string, source string, n_chars int")
    got = {r["doc_id"]: r for r in rows_of(corpus_pipeline.run(spark, d))}
    _, roots = brute_near(texts, 5, 80)
    kept = {i for i in range(len(texts)) if roots[i] == i} - {40, 41, 42, 43, 47}
    assert set(got) == kept and not {44, 45} & kept
    for i, r in got.items():
        assert not brute_matches(r["text"], [(1, passage)])[1] and not brute_personal(r["text"])
        assert r["n_chars"] == len(r["text"]) and r["n_tokens"] == len(r["ids"]) and r["decoded"]
        if i < 40:
            assert r["text"] == texts[i]
    assert passage not in got[46]["text"] and prose(901, 60) in got[46]["text"]
    assert got[48]["text"].endswith(" [EMAIL] [IP] ▁x")


def test_ids_of_the_pipeline_equal_the_library(spark):
    sp = pytest.importorskip("sentencepiece")
    ref = sp.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = ["ab  1", None, "", "▁x y", "☃"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rows_of(corpus_pipeline.encode_pieces(spark, docs, "")):
        t = texts[r["doc_id"]] or ""
        assert (list(r["ids"]), r["n_tokens"], r["decoded"]) == (ref.encode(t), len(ref.encode(t)), True)
