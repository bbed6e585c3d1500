"""Repeated windows of a corpus: which windows of a document also start earlier.

Every window of L units (bytes or words) is assigned to one anchor, the run of k units with the
smallest hash in it (the leftmost of equals). Equal windows have equal anchors at equal
distances, so repeats are found anchor by anchor:

1. `anchor_runs`: an anchor with the windows assigned to it, which follow each other: its hash
   `a`, the hash `c` of all units those windows cover, their first start and their number.
2. Only anchors whose hash occurs twice can hold repeats; the rest go.
3. Runs with equal (a, c) hold the same windows: all but the first are repeats as a whole.
4. First runs whose anchor has other runs with another c are opened: their windows are compared
   one by one. These are the ends of repeated passages, few against all windows.

Equality rests on 128 bits: two independent 64-bit hashes. Joins are on (a) or (a, c), counts are
combined before they are moved, and large keys are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metricloom.llm import common

_SPANS = common.Powers(0xD6E8FEB86659FD93)
_OTHER = common.Powers(0xA0761D6478BD642F)
RUNS = "a long, c long, doc_id long, first int, n int, own boolean"


@dataclass(frozen=True)
class Units:
    """How a text is cut: units of a block of texts (hashes, first unit of each text), window and anchor length."""

    of: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    window: int
    anchor: int


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` neighbours, by running minima from both sides of equal blocks."""
    n = len(key) - width + 1
    full = np.full(-(-len(key) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    full[: len(key)] = key
    grid = full.reshape(-1, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1: width - 1 + n])


def runs_of(units: np.ndarray, first: np.ndarray, cut: Units) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor, in a block of texts: (text, start in the block, n, a, c)."""
    length, width = cut.window, cut.window - cut.anchor + 1
    empty = np.empty(0, np.int64)
    if len(units) < length:
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    grams = common.gram_hash(units, cut.anchor)
    low = np.uint64(0xFFFFFFFF)
    key = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(key, width) & low).astype(np.int64)
    inside = np.zeros(len(anchor), bool)
    for a, b in zip(first[:-1], first[1:], strict=True):
        inside[a: max(a, b - length + 1)] = True
    start = np.flatnonzero(inside)
    if not len(start):
        return empty, empty, empty, empty.astype(np.uint64), empty.astype(np.uint64)
    at = anchor[start]
    opens = np.ones(len(start), bool)
    opens[1:] = (at[1:] != at[:-1]) | (np.diff(start) != 1)
    head = np.flatnonzero(opens)
    n = np.diff(np.append(head, len(start)))
    begin, at = start[head], at[head]
    a = grams[at]
    c = _SPANS.spans(_SPANS.sums(units), begin, begin + n + length - 1)
    c = common.mix(c ^ common.mix((at - begin).astype(np.uint64) * np.uint64(1 << 20) + n.astype(np.uint64)))
    return np.searchsorted(first, begin, "right") - 1, begin, n, a, c


def anchor_runs(docs: DataFrame, cut: Units) -> DataFrame:
    """Every anchor of `keyed` documents with its run of windows (RUNS); `own`: the document's first run with this (a, c)."""
    schema = pa.schema([("a", pa.int64()), ("c", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("n", pa.int32()), ("own", pa.bool_())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = common.texts(batch)
            ids = batch.column(0).to_numpy()
            for lo, hi in common.blocks(offsets):
                units, first = cut.of(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                text, begin, n, a, c = runs_of(units, first, cut)
                own = np.zeros(len(a), bool)
                own[np.unique(common.mix(a ^ common.mix(c ^ common.mix(text.astype(np.uint64)))), return_index=True)[1]] = True
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a.view(np.int64)), pa.array(c.view(np.int64)), pa.array(ids[lo + text]),
                     pa.array((begin - first[text]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(extract, RUNS)


def opened(batches: Iterator[pa.RecordBatch], cut: Units, classes: Callable) -> Iterator[pa.RecordBatch]:
    """The windows of the runs in `open`, as one row per document and class: digest x, y, first start, all starts.

    `classes(units, start)` gives the digests of the windows that begin at `start` in a block.
    """
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("doc_id", pa.int64()), ("first", pa.int32()), ("starts", pa.list_(pa.int32()))])
    for batch in batches:
        batch = batch.filter(batch.column(2).is_valid())
        if not batch.num_rows:
            continue
        body, offsets = common.texts(batch)
        ids, lists = batch.column(0).to_numpy(), batch.column(2)
        begins, runs = lists.offsets.to_numpy(), lists.values
        firsts, ns = runs.field(0).to_numpy(), runs.field(1).to_numpy()
        for lo, hi in common.blocks(offsets):
            units, first = cut.of(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
            own = slice(begins[lo], begins[hi])
            head = firsts[own] + np.repeat(first[:-1], np.diff(begins[lo: hi + 1]))
            n = ns[own].astype(np.int64)
            start = np.repeat(head - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            x, y = classes(units, start)
            text = np.searchsorted(first, start, "right") - 1
            order = np.lexsort((start, y, x, text))
            text, x, y, start = text[order], x[order], y[order], start[order] - first[text[order]]
            new = np.ones(len(start), bool)
            new[1:] = (text[1:] != text[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])
            at = np.flatnonzero(new)
            yield pa.RecordBatch.from_arrays(
                [pa.array(x[at].view(np.int64)), pa.array(y[at].view(np.int64)), pa.array(ids[lo + text[at]]), pa.array(start[at].astype(np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.append(at, len(start)).astype(np.int32)), pa.array(start.astype(np.int32)))], schema=schema)


def window_digests(units: np.ndarray, start: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit digests of the windows at `start`."""
    x = _SPANS.spans(_SPANS.sums(units), start, start + length)
    again = common.mix(units, 0x5851F42D4C957F2D)
    return x, _OTHER.spans(_OTHER.sums(again), start, start + length)


def repeated(docs: DataFrame, cut: Units, classes: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(doc_id, first, n): runs of window starts of `keyed` documents that also start earlier in the corpus."""
    runs = anchor_runs(docs, cut)
    often = runs.groupBy("a").agg(F.count("*").alias("_n"), F.min("c").alias("_lo"), F.max("c").alias("_hi")).where("_n > 1")
    # the counts are written, so that the joins meet them by exchanges and can split an anchor that very many documents have
    often = common.settle(often.select("a", F.expr("_lo < _hi").alias("several")))
    active = common.settle(runs.join(often, "a"))
    least = common.settle(active.groupBy("a", "c").agg(F.min("doc_id").alias("_doc"), F.count("*").alias("_n")).where("_n > 1").drop("_n"))
    tied = active.join(least, ["a", "c"], "left").withColumn("head", F.expr("own and doc_id = coalesce(_doc, doc_id)"))
    later = tied.where("not head").select("doc_id", "first", "n")
    heads = tied.where("head and several").groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("open"))
    # joined from the left without a filter, so that this exchange of the texts is the one the final step uses
    look = docs.join(heads, "doc_id", "left").select("doc_id", "text", "open")
    seen = look.mapInArrow(lambda batches: opened(batches, cut, classes), "x long, y long, doc_id long, first int, starts array<int>")
    once = seen.groupBy("x", "y").agg(F.min("doc_id").alias("_doc"), F.count("*").alias("_n"))
    ends = seen.join(once, ["x", "y"]).where("_n > 1 or size(starts) > 1")
    starts = F.explode(F.expr("if(doc_id = _doc, slice(starts, 2, size(starts)), starts)"))
    return later.unionByName(ends.select("doc_id", starts.alias("first"), F.lit(1).alias("n")))


def with_spans(docs: DataFrame, repeats: DataFrame) -> DataFrame:
    """(doc_id, text, spans) of every document; spans is null where nothing repeats."""
    lists = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("first", "n")).alias("spans"))
    return docs.join(lists, "doc_id", "left").select("doc_id", "text", "spans")


def covered(spans: pa.Scalar, units: int, length: int) -> np.ndarray:
    """Which units the windows of a document's spans cover."""
    edge = np.zeros(units + 1, np.int32)
    values = spans.values
    first, n = values.field(0).to_numpy(), values.field(1).to_numpy()
    np.add.at(edge, first, 1)
    np.add.at(edge, first + n + length - 1, -1)
    return np.cumsum(edge)[:units] > 0
