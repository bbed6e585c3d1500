"""Suffix-array dedup of whole texts by prefix-free parsing.

Parse: a rolling hash over 24 bytes sets the triggers (the smallest of every 77 neighbours, so
that each 100-byte string holds one) and cuts the corpus into phrases, one per trigger. A phrase
carries the bytes its strings reach into the next one, so every 100-byte string lies in exactly
one phrase, and equal strings lie in phrases of equal triggers at equal distances. A phrase is
named by two 64-bit hashes, of its trigger and of all its bytes.

Parse in corpus order: phrases are dealt by trigger and sorted by name and place. A phrase that
stands earlier needs no suffixes, all its strings repeat; one whose trigger no other phrase has
holds nothing that repeats. Copies within a block of text are settled before anything is moved.

Dictionary: what is left, phrases that share a trigger but not all bytes, is fetched from the
texts and dealt by trigger. Each run of triggers gets a suffix array (`suffix_ranks`: the first
8 bytes, then prefix doubling to the depth of 100). Suffixes of equal rank are one string; the
parse gives its first place in corpus order, all others repeat it.

Triggers that very many different phrases have (the ends of a passage that a large part of the
corpus holds) would meet in one task. Those with more than one in `CROWDED` of all phrases, so at
most `CROWDED` triggers, are cut into their strings before they are moved, and strings are dealt
by their own hash.

Defined results: a null or empty text has no bytes; a null doc_id counts as the smallest and is
returned as null; rows that repeat a doc_id are one document, with the largest of their texts;
other columns are ignored. A text of any length is read whole. Matches end at document borders.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metricloom.llm import common, repeats

LENGTH = 100
TRIGGER = 24
#: A trigger with one in CROWDED phrases is cut into strings; it is a candidate with more than MANY different phrases in a block of text.
CROWDED, MANY = 2000, 1


def _units(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return common.byte_units(body), offsets


def suffix_ranks(body: np.ndarray, depth: int) -> np.ndarray:
    """Rank of every suffix of a byte string by its first `depth` bytes; suffixes alike to that depth share a rank.

    Ranks by the first 8 bytes, then prefix doubling: pairs of ranks are sorted and numbered anew.
    """
    padded = np.concatenate([body, np.zeros(8, np.uint8)]).astype(np.uint64)
    known = min(8, depth)
    key = np.zeros(len(body), np.uint64)
    for i in range(known):
        key = key << np.uint64(8) | padded[i: i + len(body)]
    rank = np.unique(key, return_inverse=True)[1].astype(np.uint64)
    while known < depth:
        step = min(known, depth - known)
        ahead = np.zeros(len(rank), np.uint64)
        ahead[: max(0, len(rank) - step)] = rank[step:]
        rank = np.unique((rank << np.uint64(32)) | ahead, return_inverse=True)[1].astype(np.uint64)
        known += step
    return rank


def crowded(docs: DataFrame, cut: repeats.Units, share: int = CROWDED) -> np.ndarray:
    """The triggers with at least one in `share` of all phrases, different ones per block of text, sorted: no more than `share`."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = common.texts(batch)
            for lo, hi in common.blocks(offsets):
                units, first = cut.of(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                _, _, _, a, c = repeats.runs_of(units, first, cut)
                own, n = np.unique(np.unique(np.stack([a, c]), axis=1)[0] if len(a) else a, return_counts=True)
                triggers, phrases = own[n > MANY].view(np.int64), n[n > MANY]
                # the row without a trigger counts all phrases
                yield pa.RecordBatch.from_arrays([pa.array([*triggers.tolist(), None], pa.int64()), pa.array([*phrases.tolist(), len(a)], pa.int64())], names=["a", "n"])

    found = common.settle(docs.select("doc_id", "text").mapInArrow(count, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")))
    total = found.where("a is null").first()
    rows = found.where(F.col("a").isNotNull() & (F.col("n") * share >= total.n)).collect() if total else []
    return np.sort(np.array([r.a for r in rows], np.int64))


PHRASE = "a long, c long, doc_id long, first int, n int, again boolean"


def parse(docs: DataFrame, cut: repeats.Units, hot: np.ndarray) -> DataFrame:
    """The phrases (PHRASE) of `keyed` documents; `again`: an equal one stands earlier in the same block of text."""
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = common.texts(batch)
            ids = batch.column(0).to_numpy()
            for lo, hi in common.blocks(offsets):
                units, first = cut.of(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                text, begin, n, a, c = repeats.runs_of(units, first, cut)
                split = np.isin(a.view(np.int64), hot)
                if split.any():
                    m = n[split]
                    start = np.repeat(begin[split] - np.concatenate([[0], np.cumsum(m)[:-1]]), m) + np.arange(m.sum())
                    x, y = repeats.window_digests(units, start, cut.window)
                    text, begin, n = (np.concatenate([v[~split], w]) for v, w in ((text, np.repeat(text[split], m)), (begin, start), (n, np.ones(len(start), n.dtype))))
                    a, c = np.concatenate([a[~split], x]), np.concatenate([c[~split], y])
                doc, begin = ids[lo + text], begin - first[text]
                order = np.lexsort((begin, doc, c, a))
                again = np.zeros(len(order), bool)
                again[1:] = (a[order][1:] == a[order][:-1]) & (c[order][1:] == c[order][:-1])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a[order].view(np.int64)), pa.array(c[order].view(np.int64)), pa.array(doc[order]), pa.array(begin[order].astype(np.int32)),
                     pa.array(n[order].astype(np.int32)), pa.array(again)], names=["a", "c", "doc_id", "first", "n", "again"])

    return docs.select("doc_id", "text").mapInArrow(phrases, PHRASE)


def _groups(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """Sorted batches as tables that end where column `a` changes and hold about `size` bytes."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) < size:
            continue
        table = pa.Table.from_batches(held)
        a = table.column("a").to_numpy()
        end = int(np.searchsorted(a, a[-1]))
        if end:
            yield table.slice(0, end)
            held = table.slice(end).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Phrases sorted by trigger, name and place: those that repeat (open false) and those to be looked into."""
    for table in _groups(batches, common.BLOCK):
        a, c, doc, first, n, again = (table.column(i).to_numpy() for i in range(6))
        same = np.zeros(len(a), bool)
        same[1:] = a[1:] == a[:-1]
        alike = same.copy()
        alike[1:] &= c[1:] == c[:-1]
        # a trigger is shared if its first and last phrase differ, as they are sorted by name
        group = np.cumsum(~same) - 1
        head, tail = np.flatnonzero(~same), np.append(np.flatnonzero(~same)[1:], len(a)) - 1
        shared = (c[head] != c[tail])[group] if len(a) else same
        late, look = alike | again, shared & ~alike & ~again
        keep = late | look
        yield pa.RecordBatch.from_arrays([pa.array(doc[keep]), pa.array(first[keep]), pa.array(n[keep]), pa.array(a[keep], mask=~look[keep])], names=["doc_id", "first", "n", "a"])


def dictionary(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The bytes of the phrases to be looked into: (a, doc_id, first, n, body)."""
    schema = pa.schema([("a", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("body", pa.binary())])
    for batch in batches:
        batch = batch.filter(batch.column(2).is_valid())
        for lo in range(0, batch.num_rows, 64):
            out = []
            for key, text, runs in zip(*(batch.column(i).slice(lo, 64) for i in range(3)), strict=True):
                raw, values = text.as_buffer().to_pybytes(), runs.values
                for first, n, a in zip(*(values.field(i).to_pylist() for i in range(3)), strict=True):
                    out.append((a, key.as_py(), first, n, raw[first: first + n + length - 1]))
            yield common.batch_of(out, schema)


def suffix_classes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Runs of strings that also start earlier, by suffix arrays over the dictionary of each run of triggers."""
    for table in _groups(batches, common.BLOCK):
        doc, first, n = (table.column(c).to_numpy() for c in ("doc_id", "first", "n"))
        bodies = table.column("body").combine_chunks()
        bodies = pa.concat_arrays(bodies.chunks) if isinstance(bodies, pa.ChunkedArray) else bodies
        offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset: bodies.offset + len(bodies) + 1].astype(np.int64)
        rank = suffix_ranks(np.frombuffer(bodies.buffers()[2], np.uint8)[offsets[0]: offsets[-1]], length)
        at = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        row = np.repeat(np.arange(len(n)), n)
        start, rank = first[row] + at, rank[(offsets[:-1] - offsets[0])[row] + at]
        order = np.lexsort((start, doc[row], rank))
        late = np.zeros(len(order), bool)
        late[order[1:]] = rank[order[1:]] == rank[order[:-1]]
        # neighbouring strings of a phrase as one run
        begins = late.copy()
        begins[1:] &= ~(late[:-1] & (row[1:] == row[:-1]))
        open_at = np.flatnonzero(begins)
        ends = late.copy()
        ends[:-1] &= ~(late[1:] & (row[1:] == row[:-1]))
        yield pa.RecordBatch.from_arrays([pa.array(doc[row[open_at]]), pa.array(start[open_at].astype(np.int32)),
                                          pa.array((np.flatnonzero(ends) - open_at + 1).astype(np.int32))], names=["doc_id", "first", "n"])


def repeated_strings(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """(doc_id, text, spans) with the strings of each document that also start earlier."""
    docs, cut = common.keyed(docs), repeats.Units(_units, length, trigger)
    phrases = parse(docs, cut, crowded(docs, cut))
    # phrases settled in their block go anywhere
    dealt = phrases.repartition(F.when(F.col("again"), F.xxhash64("doc_id", "first")).otherwise(F.col("a")))
    placed = common.settle(dealt.sortWithinPartitions("a", "c", "doc_id", "first").mapInArrow(ordered, "doc_id long, first int, n int, a long"))
    look = placed.where("a is not null").groupBy("doc_id").agg(F.collect_list(F.struct("first", "n", "a")).alias("open"))
    # joined from the left without a filter, so that this exchange of the texts is the one the final step uses
    words = docs.join(look, "doc_id", "left").select("doc_id", "text", "open").mapInArrow(
        lambda batches: dictionary(batches, length), "a long, doc_id long, first int, n int, body binary")
    ends = words.repartition("a").sortWithinPartitions("a", "doc_id", "first").mapInArrow(
        lambda batches: suffix_classes(batches, length), "doc_id long, first int, n int")
    return repeats.with_spans(docs, placed.where("a is null").select("doc_id", "first", "n").unionByName(ends))


def suffix_dedup(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER, text: bool = False) -> DataFrame:
    """Kept bytes of every document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept.

    kept is binary; with `text` a string, without the bytes of characters that a cut leaves incomplete.
    """
    kind = "string" if text else "binary"
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept", pa.string() if text else pa.binary())])

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = []
                for key, body, spans in zip(*(batch.column(i).slice(lo, 256) for i in range(3)), strict=True):
                    kept, runs = body.as_buffer().to_pybytes(), 0
                    total = len(kept)
                    if spans.is_valid:
                        out = repeats.covered(spans, total, length)
                        runs = int(np.count_nonzero(np.diff(np.concatenate([[False], out]).astype(np.int8)) == 1))
                        kept = np.frombuffer(kept, np.uint8)[~out].tobytes()
                    rows.append((key.as_py(), total, total - len(kept), runs, hashlib.sha256(kept).hexdigest(), kept.decode(errors="ignore") if text else kept))
                yield common.batch_of(rows, schema)

    out = repeated_strings(docs, length, trigger).mapInArrow(
        trim, f"doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept {kind}")
    return common.unkeyed(out, "doc_id")
