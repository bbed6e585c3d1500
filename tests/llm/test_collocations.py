"""Collocations against brute force over every phrase of every piece."""

import re
from collections import Counter

import pytest

from metricloom.llm import collocations as c


def brute(rows, least, cover, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\\x0A-\\x0D]", folded):
            words = re.findall("[^\\x20\\x09]+", piece)
            totals[lang] += len(words)
            counts.update((lang, tuple(words[i: i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    frequent = {key: a for key, a in counts.items() if len(key[1]) > 1 and a >= least}
    out = []
    for (lang, w), a in frequent.items():
        longer = [b for (other, v), b in frequent.items() if other == lang and len(v) > len(w) and any(v[i: i + len(w)] == w for i in range(len(v) - len(w) + 1))]
        if any(100 * b >= cover * a for b in longer):
            continue
        n = totals[lang]
        score, k = min((1000 * a * n // (counts[lang, w[:k]] * counts[lang, w[k:]]), k) for k in range(1, len(w)))
        out.append((lang, " ".join(w), a, counts[lang, w[:k]], counts[lang, w[k:]], n, score))
    out.sort(key=lambda r: (r[0], -r[6], -r[2], r[1].encode()))
    ranks = Counter()
    return [(r[0], ranks[r[0]], *r[1:]) for r in out if not ranks.update([r[0]]) and ranks[r[0]] <= top]


def found(df, **options):
    return sorted(map(tuple, c.collocations(df, **options).collect()))


@pytest.mark.parametrize(("least", "cover", "top", "modulus"), [(3, 100, 10_000, 16), (2, 60, 40, 1), (5, 100, 7, 2)])
def test_equals_brute_force(spark, documents, corpus, monkeypatch, least, cover, top, modulus):
    monkeypatch.setattr(c, "MODULUS", modulus)
    rows = [("en" if i % 3 else "fr", t) for i, t in corpus]
    assert found(documents, least=least, cover=cover, top=top) == sorted(brute(rows, least, cover, top))


def test_odd_texts(spark, nothing):
    assert c.collocations(nothing, least=1).count() == 0
    rows = [(None, None), (None, "A b\tB. a b c"), ("en", ""), ("en", "..;"), ("en", "x"), ("en", "é" * 300_000 + " y " * 3), ("en", "a a " * 5000 + "日 本,日 本"),
            ("und", "a B"), (None, "A b\x0bb c\x0c\x0d"), ("", "a b a b"), ("en", "\x00 \x00 \x00")]
    frame = spark.createDataFrame([(1, t, lang, "k", 7, "x") for lang, t in rows], "doc_id long, text string, lang string, a string, n int, phrase string")
    assert found(frame, least=1, top=10**6) == sorted(brute(rows, 1, 100, 10**6))


def test_each_overlap_is_counted_once(spark):
    """Where every window is a trigger, chunks overlap the most."""
    rows = [("en", "q w e r t y " * 50)] * 3
    frame = spark.createDataFrame(rows, "lang string, text string")
    for modulus in (1, 3, 10**9):
        c.MODULUS, before = modulus, c.MODULUS
        try:
            assert found(frame, least=2, top=100) == sorted(brute(rows, 2, 100, 100))
        finally:
            c.MODULUS = before


def test_repeated_passages_are_counted_in_the_dictionary(spark):
    """A text that stands there a thousand times makes the dictionary no larger."""
    text = " ".join(f"w{i % 97}" for i in range(2000))
    once = c.parse(spark.createDataFrame([("en", text)], "lang string, text string"))
    many = c.parse(spark.createDataFrame([("en", text)] * 1000, "lang string, text string"))
    assert many.count() == once.count()
    assert {r.n for r in many.where("n > 0").collect()} == {1000 * r.n for r in once.collect()}
