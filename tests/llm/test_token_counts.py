"""Token counts against the library itself, and what the cache does."""

import pytest

from metricloom.llm import token_counts as t
from metricloom.llm.queries import piece_model_path, tokenizer_path

sentencepiece = pytest.importorskip("sentencepiece")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=piece_model_path())


def counts(frame):
    return sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in frame.collect()), key=str)


def cached(spark, folder, path):
    return {bytes(r.digest): r.n_tokens for r in spark.read.parquet(f"{folder}/tokenizer={t.version(path)}").collect()}


def test_equals_library_and_reads_the_cache(spark, documents, corpus, model, tmp_path):
    cache, path = str(tmp_path / "cache"), piece_model_path()
    want = sorted(((i, len((x or "").encode()), len(model.encode(x or "")), len(model.encode(x or "")) > 500) for i, x in corpus), key=str)
    assert counts(t.token_counts(documents, path, cache, limit=500)) == want
    first = cached(spark, cache, path)
    assert len(first) == len({x or "" for _, x in corpus}) == spark.read.parquet(cache).count()
    # all is stored now: the same counts, and nothing more is stored
    assert counts(t.token_counts(documents, path, cache, limit=500)) == want
    assert spark.read.parquet(cache).count() == len(first)
    # new texts alone are appended
    more = documents.select("doc_id", "text").unionByName(spark.createDataFrame([(900, "a new text"), (901, "a new text")], "doc_id long, text string"))
    got = counts(t.token_counts(more, path, cache, limit=500))
    assert got == sorted(want + [(i, 10, len(model.encode("a new text")), False) for i in (900, 901)], key=str)
    assert spark.read.parquet(cache).count() == len(first) + 1


def test_stored_counts_are_taken_and_belong_to_one_tokenizer(spark, tmp_path):
    cache = str(tmp_path / "cache")
    frame = spark.createDataFrame([(1, "some words"), (2, "other")], "doc_id long, text string")
    digest = frame.selectExpr("unhex(sha2(text, 256)) as digest", "cast(77 as long) as n_tokens").where("true")
    for _ in range(2):  # stored twice, by two runs at once
        digest.limit(1).write.mode("append").parquet(f"{cache}/tokenizer={t.version(piece_model_path())}")
    assert 77 in {r.n_tokens for r in t.token_counts(frame, piece_model_path(), cache).collect()}
    other = tokenizers.Tokenizer.from_file(tokenizer_path())
    got = {r.doc_id: r.n_tokens for r in t.token_counts(frame, tokenizer_path(), cache).collect()}
    assert got == {1: len(other.encode("some words", add_special_tokens=False).ids), 2: len(other.encode("other", add_special_tokens=False).ids)}


def test_every_row_waits_when_the_filter_is_full(spark, documents, corpus, model, tmp_path, monkeypatch):
    import numpy as np

    monkeypatch.setattr(t.common, "bit_filter", lambda ids, name: np.full(t.common.FILTER_BITS // 8, 255, np.uint8))
    got = {r.doc_id: r.n_tokens for r in t.token_counts(documents, piece_model_path(), str(tmp_path / "c")).collect()}
    assert got == {i: len(model.encode(x or "")) for i, x in corpus}


def test_normal_form_leaves_counts_alone(model):
    assert t.keeps_space(piece_model_path()) and not t.keeps_space(tokenizer_path())
    for text in ("a b", " a", "a ", "  ", " \n ", "é  日\t x", "<s> </s> ", "a\x00 b"):
        assert len(model.encode(text)) == len(model.encode(text.replace(" ", "▁")))


def test_odd_rows(spark, odd, nothing, model, tmp_path):
    cache = str(tmp_path / "cache")
    assert t.token_counts(nothing, piece_model_path(), cache).count() == 0
    got = counts(t.token_counts(odd, piece_model_path(), cache))
    assert len(got) == 7 and sum(r[2] == 0 and r[1] == 0 for r in got) == 2 and sum(r[0] is None for r in got) == 2
    specials = ["<s>x</s><unk>", "▁", " ", "a▁b", "a b", "x" * 300_000, "\x00", "日本語" * 2000]
    frame = spark.createDataFrame([(i, s, 1, b"k", 3, 4) for i, s in enumerate(specials)], "doc_id int, text string, n_tokens int, digest binary, n_bytes int, bit int")
    assert counts(t.token_counts(frame, piece_model_path(), cache)) == sorted(((i, len(s.encode()), len(model.encode(s)), len(model.encode(s)) > 4096) for i, s in enumerate(specials)), key=str)
    assert spark.read.parquet(cache).count() == len(specials) - 1 - 1 + 3  # "a▁b" and "a b", "▁" and " " are one content each
