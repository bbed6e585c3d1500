"""The pipeline stage by stage against brute force, each on what its predecessor kept."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metricloom.llm import decontaminate

from .test_dedup import near_by_hand
from .test_others import distance

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


def cut_by_hand(rows, length=100):
    seen, out = set(), {}
    for key, text in sorted(rows):
        raw = text.encode()
        gone = [False] * len(raw)
        for i in range(len(raw) - length + 1):
            if raw[i: i + length] in seen:
                gone[i: i + length] = [True] * length
            seen.add(raw[i: i + length])
        out[key] = bytes(b for b, g in zip(raw, gone, strict=True) if not g).decode(errors="ignore")
    return out


@pytest.fixture(scope="module")
def folder(spark, documents, corpus, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    documents.select(*corpus_pipeline.COLUMNS).write.parquet(f"{path}/documents.parquet")
    passage = " ".join(corpus[-10][1].split()[-45:])
    items = [(1, dict(corpus)[60].split(" ", 40)[:40]), (2, passage.split()), (3, [f"never{i}" for i in range(12)])]
    spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, corpus):
    from metricloom.llm.queries import tokenizer_path

    tokenizer = tokenizers.Tokenizer.from_file(tokenizer_path())
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), dict(corpus)
    items = [r.text.split() for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        if name == "packing":
            break
        assert out.columns == corpus_pipeline.COLUMNS
        docs = corpus_pipeline.common.settle(out)
        got = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            want = {k: t for k, t in kept.items() if t and t.strip()}
        elif name == "near_duplicates":
            want = {k: kept[k] for k, v in near_by_hand(list(kept.items())).items() if v[2]}
        elif name == "repeated_strings":
            want = cut_by_hand(list(kept.items()))
            assert any(want[k] != kept[k] for k in want)
        else:
            leaks = set()
            for k, t in kept.items():
                words = decontaminate.item_words(t).tolist()
                for item in items:
                    w = decontaminate.item_words(" ".join(item)).tolist()
                    most = decontaminate.allowed(len(w))
                    if any(len(set(words[s: s + len(w)]) & set(w)) >= len(set(w)) - most and distance(words[s: s + len(w)], w) <= most
                           for s in range(len(words) - len(w) + 1)):
                        leaks.add(k)
            want = {k: t for k, t in kept.items() if k not in leaks}
            assert 60 in leaks
        assert got == want, name
        kept = got
    pieces = out.collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept.items()}
    assert {(r.sequence_id, r.offset) for r in pieces} == {(r.sequence_id, r.offset) for r in corpus_pipeline.run(spark, folder).collect()}


def test_stages_of_odd_documents(spark, odd, nothing, folder):
    clash = {c: F.lit(7) for c in ("_gone", "_doc", "_row", "_tie", "kept", "part", "at", "h")}
    words = odd.withColumn("text", F.translate("text", "0123456789", "abcdefghij"))
    for docs, left in ((words, 2), (odd, 0), (nothing, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs.withColumns(clash), folder)
            if name != "packing":
                assert out.columns == corpus_pipeline.COLUMNS
                docs = corpus_pipeline.common.settle(out)
        # of the same text the first row stays, and the row cut short of it; rows without letters go
        assert docs.where("text <> ''").count() == left and out.where("start = 0").count() == docs.count()


def test_rows_that_share_an_id_are_judged_each(spark, tmp_path):
    from metricloom.llm.queries import QUERIES

    rng = random.Random(8)
    a, b, c, d, e = (" ".join("".join(rng.choice("abcdefghijkl") for _ in range(6)) for _ in range(120)) for _ in range(5))
    rows = [(None, a), (None, b), (None, "12 34 " * 20), (5, c), (5, a), (5, d), (6, b[:300] + "#" + e)]
    docs = spark.createDataFrame([(i, t, None, "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    item = " ".join(d.split()[40:60])
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    noise, copy, leak = rows[2], rows[4], rows[5]
    gone = {"language": {noise}, "near_duplicates": {noise, copy}, "repeated_strings": {noise, copy}, "contamination": {noise, copy, leak}}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.common.settle(stage(spark, docs, str(tmp_path)))
        want = [r for r in rows if r not in gone[name]]
        if name in ("repeated_strings", "contamination"):
            want[-1] = (6, "#" + e)
        assert sorted(((r.doc_id, r.text) for r in docs.collect()), key=str) == sorted(want, key=str), name
    for name in ("op2_suffix_dedup", "op7_minhash_dedup", "op8_substring_dedup"):
        assert sorted((r.doc_id for r in QUERIES[name](spark, str(tmp_path)).collect()), key=str) == sorted((i for i, _ in rows), key=str), name
    near = [(r.doc_id, r.component_id, r.kept) for r in QUERIES["op7_minhash_dedup"](spark, str(tmp_path)).collect()]
    assert sorted(near, key=str) == sorted([(None, None, True)] * 3 + [(5, 5, True)] * 2 + [(5, None, False), (6, 6, True)], key=str)
