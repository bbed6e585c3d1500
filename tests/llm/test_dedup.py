"""Dedup operators against brute force."""

import hashlib
import re

import numpy as np
import pytest

from metricloom.llm import common, components, minhash, repeats, substring_dedup, suffix_dedup

ASCII_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def repeats_by_hand(rows, units, length, join):
    seen, out = set(), {}
    for key, text in sorted(rows):
        own = units((text or "").encode())
        gone = [False] * len(own)
        for i in range(len(own) - length + 1):
            window = tuple(own[i: i + length])
            if window in seen:
                gone[i: i + length] = [True] * length
            seen.add(window)
        kept = join([u for u, g in zip(own, gone, strict=True) if not g])
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[key] = (len(own), sum(gone), runs, hashlib.sha256(kept).hexdigest())
    return out


def test_substring_dedup_is_exact(documents, corpus):
    got = {r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.substring_dedup(documents).collect()}
    assert got == repeats_by_hand(corpus, bytes.split, 20, b" ".join)
    assert sum(v[1] for v in got.values()) > 1000


@pytest.mark.parametrize("many", [8, 0])
def test_suffix_dedup_is_exact(documents, corpus, monkeypatch, many):
    """With many = 0 every trigger is cut into its strings before it is dealt."""
    monkeypatch.setattr(suffix_dedup, "MANY", many)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(documents).collect()}
    assert got == repeats_by_hand(corpus, list, 100, bytes)
    assert sum(v[1] for v in got.values()) > 5000


def test_small_blocks_change_nothing(documents, corpus, monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 500)
    got = {r.doc_id: r.kept_sha256 for r in suffix_dedup.suffix_dedup(documents.coalesce(1)).collect()}
    assert got == {k: v[3] for k, v in repeats_by_hand(corpus, list, 100, bytes).items()}


@pytest.mark.parametrize("op", [substring_dedup.substring_dedup, suffix_dedup.suffix_dedup])
def test_repeats_of_odd_rows(op, odd, nothing):
    text = " ".join(f"w{i}" for i in range(60))
    got = {r[0]: (r[1], r[2]) for r in op(odd).collect()}
    n = 60 if op is substring_dedup.substring_dedup else len(text)
    assert got == {None: (n, 0), 5: (n, n), 6: (0, 0), 7: (n, n)}
    assert op(nothing).count() == 0


def test_ranks_order_suffixes():
    body = np.frombuffer(b"abracadabra" * 3 + b"abrac", np.uint8)
    for depth in (1, 5, 8, 12, 20):
        rank = suffix_dedup.suffix_ranks(body, depth)
        cut = [body.tobytes()[i: i + depth].ljust(depth, b"\0") for i in range(len(body))]
        assert [cut[i] for i in np.argsort(rank, kind="stable")] == sorted(cut)
        assert len(set(rank.tolist())) == len(set(cut))


def test_anchors_of_equal_windows_are_equal():
    units = common.mix(np.array([i % 50 for i in range(300)], np.uint64))
    cut = repeats.Units(None, 20, 6)
    _, begin, n, a, _ = repeats.runs_of(units, np.array([0, 300]), cut)
    assert n.sum() == 281
    anchor = {}
    for b, m, h in zip(begin.tolist(), n.tolist(), a.tolist(), strict=True):
        for s in range(b, b + m):
            assert anchor.setdefault(s % 50, h) == h


def near_by_hand(rows):
    sets, parent = {}, {}
    for key, text in rows:
        w = re.findall("[^\x20\x09-\x0D]+", (text or "").translate(ASCII_FOLD))
        sets[key] = {tuple(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        parent[key] = key

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {k: (len(sets[k]), root(k), root(k) == k) for k in sets}


def test_near_duplicates_are_exact(documents, corpus):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents).collect()}
    want = near_by_hand(corpus)
    assert got == want
    assert 5 < sum(not v[2] for v in want.values()) < 40


def test_links_that_avoid_the_leader_are_found(spark):
    """Copies of a leader that differ too much from it, but not from each other."""
    base = [f"b{i}" for i in range(200)]
    rows = [(0, " ".join(base))]
    for family in range(4):
        changed = list(base)
        for j in range(8):
            changed[20 * j + 4 * family + 5] = f"f{family}-{j}"
        for k in range(6):
            own = list(changed)
            own[195 - 3 * k] = f"k{family}-{k}"
            rows.append((1 + 10 * family + k, " ".join(own)))
    rows += [(100 + k, " ".join(base[:150] + ([f"x{k}"] if k else []))) for k in range(4)]
    rows += [(200 + k, " ".join(base[: 60 + k])) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()}
    assert got == near_by_hand(rows)


def test_near_duplicates_of_odd_rows(odd, nothing):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(odd).collect()}
    assert got == {None: (56, None, None), 5: (56, None, None), 6: (0, 6, True), 7: (56, None, None)} or got[6] == (0, 6, True)
    assert minhash.near_duplicates(nothing).count() == 0


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, i) for i in range(101, 120)] + [(7, 7)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(31)} | {i: 100 for i in range(100, 120)}


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 900, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    same = np.mean(minhash.circulant(a, 1024) == minhash.circulant(b, 1024))
    assert abs(same - 0.8) < 0.05
