"""The other operators: brute force, exact round trips, held-out accuracy."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import decontaminate, language_id, lm_score, packing, quality_rules, url_filter, warc
from metricloom.llm.queries import op1_decontamination, tokenizer_path

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    return tokenizers.Tokenizer.from_file(tokenizer_path())


def test_word_lookup_equals_whole_texts(tokenizer, corpus, monkeypatch):
    monkeypatch.setattr(packing, "KNOWN", 50)
    rng = random.Random(1)
    texts = [t or "" for _, t in corpus] + ["x<|endoftext|>y", "don't WON'T\x0bq\x1cz", "ΣΑΣ İ ſ ŉ", "a\x85b\xa0c", "é é", "²³ ª µ ÿ ß", "'s's x'll"]
    texts += ["".join(chr(rng.choice([rng.randint(1, 0x17F), rng.randint(32, 126), rng.randint(1, 0x3000)])) for _ in range(40)) for _ in range(300)]
    ids = packing.WordIds(tokenizer_path())
    for at in range(0, len(texts), 40):
        for text, got in zip(texts[at: at + 40], ids(texts[at: at + 40]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_words_of_one_piece_are_kept_once(tokenizer):
    """A plain word is given to the model once, whatever stands around it; the vocabulary is read once a worker."""
    ids = packing.WordIds(tokenizer_path())
    assert [np.frombuffer(i, "<u4").tolist() for i in ids(["abc Abc abc,", "x\xaay \xe9"])] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in ("abc Abc abc,", "x\xaay \xe9")]
    assert set(ids.latin) == {"abc", "Abc", "abc,", ",", "x\xaay", "\xe9"}
    read = packing._tokenizer.cache_info().misses
    packing.WordIds(tokenizer_path())
    assert packing._tokenizer.cache_info().misses == read
    packing.WordIds(tokenizer_path(), 50)  # reads its own
    assert packing._tokenizer.cache_info().misses == read


def test_packing_is_whole(spark, documents, corpus, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "ROW", 1000)
    pieces = packing.packed(documents, tokenizer_path(), width=128)
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    at = 0
    for r in rows:
        assert (r.sequence_id, r.offset) == divmod(at, 128)
        at += r.length
    for key, text in corpus:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in rows if r.doc_id == key), key=lambda r: r.start)
        assert np.concatenate([np.frombuffer(r.ids, "<u4") for r in own]).tolist() == want
        assert all(r.doc_tokens == len(want) and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length for r in own)
        assert [r.start for r in own] == np.cumsum([0, *(r.length for r in own)])[:-1].tolist()
    whole = packing.sequences(pieces, 128, pad=0).collect()
    assert all(len(r.ids) == 512 for r in whole) and sum(r.tokens for r in whole) == at


def test_packing_of_odd_rows(odd, nothing):
    assert packing.packed(nothing, tokenizer_path()).count() == 0
    assert packing.packed(odd, tokenizer_path()).where("start = 0").count() == 7


def test_warc_round_trip(spark):
    big = "long é page " * 2000
    pages = [(1, "http://a/1", "x"), (2, "http://a/2", big), (3, None, big), (4, "http://b\r\n/", None), (5, "u", "WARC/1.1\r\nContent-Length: 3\r\n\r\n" * 60),
             (6, "u", "same" * 10), (7, "u", "same" * 10), (9, "u", big), (8, "u", "ü" * 999)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.round_trip(df, segment=700).collect()}
    for key, _, html in pages:
        raw, r = (html or "").encode(), got[key]
        assert (r.payload_bytes, r.payload_digest) == (len(raw), hashlib.sha1(raw).hexdigest())
        if key in (2, 3):
            assert (r.record_type, r.refers_to, r.payload) == ("revisit", 9, None)
        else:
            assert (r.record_type, r.refers_to, bytes(r.payload)) == ("response", None, raw)
    assert warc.round_trip(df.limit(0)).count() == 0
    twice = spark.createDataFrame([(None, None, big), (4, "u", big), (4, "u", big)], "page_id long, url string, html string")
    assert sorted((r.record_type, r.refers_to) for r in warc.round_trip(twice).collect()) == [("response", None), ("revisit", 4), ("revisit", 4)]


def test_missing_segments_are_an_error(spark, tmp_path):
    df = spark.createDataFrame([(1, "u", "y" * 5000)], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "w"), segment=700)
    records = warc.read_records(spark, str(tmp_path / "w"))
    with pytest.raises(Exception, match="segments are missing"):
        warc.payloads(warc.reassembled(records.where("segment is null or segment != 3"))).collect()


def test_chunked_framing():
    assert warc.dechunked(b"4;x=1\r\nabcd\r\n0\r\n\r\n") == b"abcd"
    with pytest.raises(ValueError):
        warc.dechunked(b"4\r\nabcdX")
    for n in (0, 1, 16384, 40000):
        assert warc.dechunked(warc.chunked(b"z" * n)) == b"z" * n


def test_url_rules(spark):
    urls = ["http://EXAMPLE.com/en/1", "http://www.example.com/en/1", "https://a.www.example.com/en/", "x://b.net/es/?q", "x://net/fr/", "http://b.net/de/",
            "http://xcom/", "http://a.com?x/", None, "no scheme", "http://", "http://example.com/EN/"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(df).collect()}
    assert [got[i].rule for i in range(12)] == ["example.com/en/", "www.example.com/en/", "www.example.com/en/", "net/es/", "net/fr/", None, None, None, None, None, None, "com/"]
    assert [got[i].verdict for i in range(5)] == ["block", "allow", "allow", "block", "block"]
    assert (got[0].host, got[0].path, got[7].path, got[8].host) == ("example.com", "/en/1", "", "")
    assert {r.verdict for r in got.values()} <= {"allow", "block"}
    assert url_filter.filter_urls(df.limit(0)).count() == 0


def test_url_model_learns_held_out_urls(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{rng.randint(0, 9999)}.{('shop', 'casino')[i % 2]}-site.org/{('news', 'win')[i % 2]}/{i}") for i in range(600)]
    urls = url_filter.with_parts(spark.createDataFrame(rows, "page_id long, url string")).withColumn("ruled", F.expr("if(page_id % 2 = 1, 'block', 'allow')"))
    model = url_filter.fit(url_filter.labelled(urls.where("page_id < 400"), 100))
    out = model.transform(url_filter.features(urls.where("page_id >= 400")))
    assert out.where("prediction = page_id % 2").count() >= 195


def test_quality_statistics(spark, documents, corpus):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(64)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_rules.quality_rules(documents, labels).collect()}
    for key, text in corpus:
        words = (text or "").encode().split()
        windows = [tuple(words[i: i + 8]) for i in range(len(words) - 7)]
        covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        r = got[key]
        assert (r.n_words, r.n_repeat_words, r.n_dup_lines) == (len(words), len(covered), len(lines) - len(set(lines)))
        assert r.word_chars == sum(len(w.decode()) for w in words)
        assert r.base_failed == (len(words) < 20 or 100 * len(covered) > 30 * len(words)) and not (r.base_failed and r.kept)


def test_decision_list_finds_the_planted_rule(spark):
    rng = random.Random(5)
    rows = []
    for i in range(1500):
        bad = i % 3 == 0
        rows.append((i, float(rng.gauss(5, 1)), rng.uniform(0.2, 0.5) if bad else rng.uniform(0, 0.19), bad, rng.random() < 0.66))
    sample = spark.createDataFrame(rows, "doc_id long, mean_word double, symbol_share double, bad boolean, grown boolean")
    rules = quality_rules.learn(sample, ["mean_word", "symbol_share"])
    assert rules and rules[0][0].feature == "symbol_share" and rules[0][0].above
    wrong = sample.where(quality_rules.decided(rules) != F.col("bad")).count()
    assert wrong < 60
    assert quality_rules.learn(sample.where("not bad"), ["mean_word", "symbol_share"]) == []


def test_quality_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([(5, None, None), (None, 1, 1), (5, 1, 0), (5, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality_rules.quality_rules(odd, labels).count() == 7
    assert quality_rules.quality_rules(nothing, labels).count() == 0


def edit(rng, words, n, pool):
    words = list(words)
    for _ in range(n):
        k = rng.randrange(3)
        at = rng.randrange(1, len(words) - 1)
        if k == 0:
            words[at] = rng.choice(pool)
        elif k == 1:
            words.insert(at, rng.choice(pool))
        else:
            del words[at]
    return words


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def test_decontamination_recall(spark):
    """Against brute force over every window of every document."""
    rng = random.Random(11)
    pool = [f"w{i}" for i in range(300)]
    items = [(i, [rng.choice(pool) for _ in range(rng.randint(10, 40))]) for i in range(30)]
    docs, rows = [], []
    for i in range(120):
        inside = edit(rng, items[i % 30][1], rng.randint(0, 5), pool) if i % 2 else []
        docs.append([rng.choice(pool) for _ in range(50)] + inside + [rng.choice(pool) for _ in range(20)])
        rows.append((i, ", ".join(docs[-1]).upper()))
    want = set()
    for i, words in enumerate(docs):
        for k, item in items:
            most = decontaminate.allowed(len(item))
            for s in range(len(words) - len(item) + 1):
                if len(set(words[s: s + len(item)]) & set(item)) >= len(set(item)) - most and distance(words[s: s + len(item)], item) <= most:
                    want.add((i, k))
                    break
    found = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 40
    for r in found:
        item = items[r.item_id][1]
        assert r.distance == distance(docs[r.doc_id][r.start_word: r.start_word + len(item)], item)


def test_decontamination_recall_at_full_tolerance():
    """Items of any length are found at exactly floor(0.2 L) edits."""
    rng = random.Random(12)
    pool = [f"w{i}" for i in range(3000)]
    for length in (15, 25, 60, 120, 400):
        lost = 0
        for i in range(20):
            item = [rng.choice(pool) for _ in range(length)]
            most, copy = decontaminate.allowed(length), list(item)
            for at in rng.sample(range(length), most):
                copy[at] = f"x{at}"
            text = [f"y{j}" for j in range(30)] + copy + [f"z{j}" for j in range(30)]
            items = decontaminate.Items([7], [" ".join(item)], decontaminate.TOLERANCE, decontaminate.DRAWS, decontaminate.SAMPLED)
            words = decontaminate.item_words(" ".join(text))
            found = list(items.near(words, np.array([0, len(words)])))
            assert found in ([], [(0, 7, 30, length, most)])
            lost += not found
        assert not lost, length


def test_decontamination_takes_the_first_of_equal_windows(monkeypatch):
    """What shares a step with a window does not decide between it and another at the same distance."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    for length in (9, 20, 33):
        item = [word() for _ in range(length)]
        most = decontaminate.allowed(length)
        text = [word() for _ in range(30)]
        for _ in range(2):
            copy = list(item)
            for at in rng.sample(range(1, length - 1), most):
                copy[at] = word()
            text += copy + [word() for _ in range(17)]
        seen = set()
        for grid in (1, 64, 300, 1 << 21):
            monkeypatch.setattr(decontaminate, "GRID", grid)
            items = decontaminate.Items([7], [" ".join(item)], decontaminate.TOLERANCE, decontaminate.DRAWS, decontaminate.SAMPLED)
            seen |= {tuple(f) for f in items.near(decontaminate.item_words(" ".join(text)), np.array([0, len(text)]))}
        assert len(seen) == 1 and next(iter(seen))[2] <= 30


def test_decontamination_at_borders_and_of_short_items(spark, tmp_path):
    item = [f"w{i}" for i in range(20)]
    texts = {1: item[1:], 2: item[:-4], 3: item[2:-2], 4: item[:-5], 5: ["a", *item[:17]], 6: [*item[3:], "b"], 7: ["so", "red", "barn", "Yes"], 8: ["red", "barns"], 9: ["yes,"], 10: []}
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "doc_id long, text string")
    bench = spark.createDataFrame([(1, " ".join(item)), (2, "red barn yes"), (3, "YES"), (4, "?!"), (5, "")], "item_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): (r.start_word, r.item_words, r.distance) for r in op1_decontamination(spark, str(tmp_path)).collect()}
    assert got == {(1, 1): (0, 20, 1), (2, 1): (0, 20, 4), (3, 1): (0, 20, 4), (5, 1): (1, 20, 3), (6, 1): (0, 20, 3), (7, 2): (1, 3, 0), (7, 3): (3, 1, 0), (9, 3): (0, 1, 0)}


def test_bit_parallel_distance():
    rng = random.Random(13)
    for _ in range(400):
        a, b = ([rng.randrange(6) for _ in range(rng.randint(low, 90))] for low in (1, 0))
        far, most = distance(a, b), rng.randint(0, 90)
        assert decontaminate.edit_distance(decontaminate.word_masks(a), len(a), b, most) == min(far, most + 1)


def test_decontamination_of_odd_rows(spark, odd, nothing):
    bench = spark.createDataFrame([(1, "W0 w1 w2, w3 w4 w5 w6 w7 w8"), (2, None), (None, "w0 w1"), (3, "w1 w2")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(odd, bench).collect()), key=str)
    assert got == [(5, 1, 0)] * 3 + [(7, 1, 0), (None, 1, 0)]
    assert decontaminate.contaminated(nothing, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_languages_are_told_apart(spark):
    rng = random.Random(3)
    words = {"en": "the of and house water running light".split(), "fr": "le de et maison eau courir lumière".split()}
    rows = [(i, " ".join(rng.choice(words[k]) for _ in range(30)), k if i % 10 else None, f"h{k}{i % 3}", k, None) for i in range(300) for k in [("en", "fr")[i % 2]]]
    rows += [(900, None, "fr", "hfr1", "fr", None), (901, "", None, None, None, None), (902, "\x01\x02\x03\x04" * 9, "en", "hen1", "en", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, domain string, suffix string")
    got = {r.doc_id: r for r in language_id.identify(df.withColumn("text", F.coalesce("text", F.lit("")))).collect()}
    assert all(got[i].language == ("en", "fr")[i % 2] and got[i].kept for i in range(300))
    assert got[900].language == "fr" and not any(got[i].kept for i in (900, 901, 902))


def test_languages_of_few_rows_are_learned(spark):
    rng = random.Random(6)
    words = {"en": "the of and house water running light".split(), "fr": "le de et maison eau courir lumière".split(), "es": "el que y casa agua correr luz".split(),
             "ja": "日本 言葉 水流 光線 家族".split(), "el": "Θάλασσα ουρανός".split()}
    sizes = {"en": 19, "fr": 7, "es": 3, "ja": 2, "el": 1}
    text = lambda k: " ".join(rng.choice(words[k]) for _ in range(30))
    rows = [(text(k), k, f"h{k}", k) for k, n in sizes.items() for _ in range(n)] + [(text(k), None, None, k) for k in sizes]
    # other words of a script of which one text is known
    rows += [("γράμμα χωρίς πρότυπο δίπλα φως νερό " * 3, "el", None, "el"), ("12 34 56 -- !! ~~ " * 5, None, None, None)]
    df = spark.createDataFrame([(i, t, k, h, None, None) for i, (t, k, h, _) in enumerate(rows)], "doc_id long, text string, declared string, host string, domain string, suffix string")
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert [got[i].language for i, r in enumerate(rows) if r[3]] == [r[3] for r in rows if r[3]]
    assert all(got[i].kept == (r[3] is not None) for i, r in enumerate(rows))
    undeclared = {r.doc_id: r for r in language_id.identify(df.withColumn("declared", F.lit(None).cast("string"))).collect()}
    assert all(undeclared[i].kept == (r[3] is not None) and undeclared[i].language is None for i, r in enumerate(rows))


def test_language_of_pages_and_odd_rows(spark, odd, nothing):
    pages = spark.createDataFrame([(1, "https://WWW.Example.fr:80/x", "<!doctype html><html class=a lang='FR'><script>var x</script><b>Le</b>"), (2, None, None)], "page_id long, url string, html string")
    r = {x.doc_id: x for x in language_id.of_pages(pages).collect()}
    assert (r[1].declared, r[1].host, r[1].domain, r[1].suffix) == ("fr", "www.example.fr", "example.fr", "fr") and "var" not in r[1].text
    assert language_id.identify(language_id.of_documents(odd)).count() == 7
    assert language_id.identify(language_id.of_documents(nothing)).count() == 0


def test_score_is_the_difference_of_losses(spark):
    """Held-out documents of the target's kind score below others; losses equal a plain computation."""
    rng = random.Random(4)
    good, other = [[rng.choice(pool) for _ in range(40)] for pool in (["a", "b", "c", "d"],) for _ in range(60)], [[rng.choice("wxyzab") for _ in range(40)] for _ in range(60)]
    rows = [(i, " ".join(t)) for i, t in enumerate(good + other)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(999, 1, 0), (70, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in lm_score.scored(docs, labels, cells=1 << 16).collect()}
    assert max(got[i].score for i in range(30, 60)) < min(got[i].score for i in range(60, 120))

    def losses(texts, scale):
        uni, bi, before = {}, {}, {}
        for t in texts:
            for p, w in zip([None, *t], t, strict=False):
                uni[w], bi[p, w], before[p] = uni.get(w, 0) + scale, bi.get((p, w), 0) + scale, before.get(p, 0) + scale
            # the last word of a text counts as a previous word too
            before[t[-1]] = before.get(t[-1], 0) + scale
        vocabulary = sorted({w for t in good + other for w in t})
        single = {w: uni.get(w, 0) + lm_score.ADDED for w in [*vocabulary, "?"]}
        total = sum(single.values())
        return lambda p, w: -np.log((bi.get((p, w), 0) + lm_score.WEIGHT * single[w] / total) / (before.get(p, 0) + lm_score.WEIGHT))
    target, background = losses(good[:30], 1), losses(good + other, 30 / 120)
    for i in (0, 45, 100):
        t = rows[i][1].split()
        assert got[i].target_loss == pytest.approx(np.mean([target(p, w) for p, w in zip([None, *t], t, strict=False)]))
        assert got[i].background_loss == pytest.approx(np.mean([background(p, w) for p, w in zip([None, *t], t, strict=False)]), rel=1e-6)


def test_scores_count_all_words_and_targets(spark, monkeypatch):
    """More words than any fixed vocabulary, exact whether a pair is joined or at hand."""
    rows = [(i, " ".join(f"u{i}x{j}" for j in range(1000))) for i in range(80)] + [(80, "u0x0 u0x1 u0x2")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = []
    for hot in (1, 1 << 16, 1 << 20):
        monkeypatch.setattr(lm_score, "HOT", hot)
        got.append({r.doc_id: r for r in lm_score.scored(docs, labels).collect()})
    assert len(got[0]) == 81 and all(r.n_unknown == 0 for r in got[0].values())
    size, scale = 80001, 40000 / 80003
    single = lambda n: (n + 0.5) / (40000 + 0.5 * size)
    pair = lambda n, w, b: -np.log((n + 100 * single(w)) / (b + 100))
    target = (pair(1, 1, 40) + 2 * pair(1, 1, 1)) / 3
    background = (pair(2 * scale, 2 * scale, 81 * scale) + 2 * pair(2 * scale, 2 * scale, 2 * scale)) / 3
    for one in got:
        assert one[80].target_loss == pytest.approx(target) and one[80].background_loss == pytest.approx(background)
        assert all(one[i].score == pytest.approx(got[0][i].score) for i in range(80)) and max(one[i].score for i in range(40)) < min(one[i].score for i in range(40, 80))


def test_scores_of_odd_rows(spark, odd, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = lm_score.scored(odd, labels, cells=1 << 12).collect()
    assert len(got) == 7 and all((r.score is None) == (r.n_tokens == 0) and not r.score for r in got)
    assert lm_score.scored(nothing, labels, cells=1 << 12).count() == 0
