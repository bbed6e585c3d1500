"""Counted numbers: distinct values, least values and exact ranks of whole and floating columns.

Each task sorts its values a block at a time and keeps every distinct one once, as a 64-bit integer
of the same order. Values go to parts of their column's range, part by part to tasks, where they
are told apart and the first ones noted. Rows per part tell which part holds a rank; only the
values of such parts are looked at again. Cuts between parts come from a sample of the rows, but
they only split the work: any cuts give the same result, and every value is counted.
"""

from __future__ import annotations

import sys
from collections import defaultdict
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.session import by_rows

# tasks get these functions themselves, so that workers need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a column in one part, about; parts at most; rows the cuts are taken from; rows sorted at once.
PART_ROWS, MOST_PARTS, SAMPLED, BLOCK = 1 << 18, 1 << 10, 1 << 16, 1 << 20
#: All bits but the sign, and the place of NaN, behind all numbers.
_BITS = np.int64((1 << 63) - 1)
_NAN = np.float64("nan").view(np.int64) & _BITS

Batches = Iterator[pa.RecordBatch]


def _ordered(values: np.ndarray) -> np.ndarray:
    """64-bit integers in the order of numbers. Zero has no sign, and NaN is one value."""
    if values.dtype.kind != "f":
        return values
    bits = (values + 0.0).view(np.int64)
    return np.where(np.isnan(values), _NAN, bits ^ ((bits >> 63) & _BITS))


def _restored(ordered: np.ndarray, floating: bool) -> np.ndarray:
    return (ordered ^ ((ordered >> 63) & _BITS)).view(np.float64) if floating else ordered


def _distinct(ordered: np.ndarray) -> np.ndarray:
    """Where each distinct value of a sorted array begins."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return np.flatnonzero(new)


def _blocks(batches: Batches) -> Iterator[list[np.ndarray]]:
    """The values of each column that are not null, in blocks of about BLOCK rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield _values(held)
            held, rows = [], 0
    if rows:
        yield _values(held)


def _values(held: Sequence[pa.RecordBatch]) -> list[np.ndarray]:
    return [_ordered(column.drop_null().to_numpy()) for column in pa.Table.from_batches(held).columns]


def _cuts(df: DataFrame, rows: int) -> list[np.ndarray]:
    """Cuts of each column into parts of about PART_ROWS rows; none for a small table."""
    parts = min(MOST_PARTS, -(-rows // PART_ROWS))
    if parts <= 1:
        return [np.empty(0, np.int64) for _ in df.columns]
    seen = df.sample(min(1.0, SAMPLED / rows), 1).toArrow()
    cuts = []
    for column in seen.columns:
        values = np.sort(_ordered(column.drop_null().to_numpy()))
        cuts.append(np.unique(values[np.arange(1, parts) * len(values) // parts]) if len(values) else values)
    return cuts


def _tally(cuts: list[np.ndarray], floating: list[bool]) -> Callable[[Batches], Batches]:
    """Rows and distinct values by column and part; NaN is a value, but no row to be ranked."""

    def given(column: int, values: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
        edges = np.concatenate(([0], np.searchsorted(values, cuts[column]), [len(values)]))
        lists = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(values))
        parts = len(rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.arange(parts, dtype=np.int32)), pa.array(np.full(parts, column, np.int32)), pa.array(rows), lists],
            names=["part", "column", "rows", "values"]).filter(pa.array((np.diff(edges) > 0) | (rows > 0)))

    def run(batches: Batches) -> Batches:
        found = [np.empty(0, np.int64) for _ in cuts]
        rows = [np.zeros(len(c) + 1, np.int64) for c in cuts]
        for block in _blocks(batches):
            for i, values in enumerate(block):
                values = np.sort(values)
                ranked = np.searchsorted(values, _NAN) if floating[i] else len(values)
                rows[i] += np.diff(np.concatenate(([0], np.minimum(np.searchsorted(values, cuts[i]), ranked), [ranked])))
                values = values[_distinct(values)]
                if len(found[i]):
                    values = np.sort(np.concatenate((found[i], values)))
                    values = values[_distinct(values)]
                found[i] = values
                if len(values) >= BLOCK:
                    yield given(i, values, rows[i])
                    found[i], rows[i] = values[:0], np.zeros_like(rows[i])
        for i, values in enumerate(found):
            yield given(i, values, rows[i])

    return run


def _told_apart(least: int) -> Callable[[Batches], Batches]:
    """Rows, number of distinct values and the least of them, by column and part."""

    def run(batches: Batches) -> Batches:
        rows, held = defaultdict(int), defaultdict(list)
        for batch in batches:
            part, column, n = (batch.column(i).to_pylist() for i in range(3))
            lists = batch.column(3)
            offsets, values = lists.offsets.to_numpy(), lists.values.to_numpy()
            for i, key in enumerate(zip(column, part, strict=True)):
                rows[key] += n[i]
                held[key].append(values[offsets[i]:offsets[i + 1]])
        out = []
        for key in sorted(held):
            values = np.sort(np.concatenate(held.pop(key)))
            at = _distinct(values)
            out.append((*key, rows[key], len(at), values[at[:least]].tolist()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) if i < 4 else pa.array(c, pa.list_(pa.int64())) for i, c in enumerate(zip(*out, strict=True))],
                                             names=["column", "part", "rows", "distinct", "least"])

    return run


def _looked_into(wanted: list[tuple[int, int, int, int]]) -> Callable[[Batches], Batches]:
    """Values and how often they occur, of the parts ``(column, low, high, ...)`` that ranks are looked for in."""

    def run(batches: Batches) -> Batches:
        def given(slot: int, values: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(values), slot, np.int32)), pa.array(values), pa.array(n)], names=["slot", "value", "n"])

        held = {slot: (np.empty(0, np.int64),) * 2 for slot in range(len(wanted))}
        for block in _blocks(batches):
            for slot, (column, low, high, *_) in enumerate(wanted):
                values = block[column]
                values = values[(values >= low) & (values <= high)]
                if len(values):
                    held[slot] = _added(*(np.concatenate(c) for c in zip(held[slot], (values, np.ones(len(values), np.int64)), strict=True)))
                if len(held[slot][0]) >= BLOCK:
                    yield given(slot, *held[slot])
                    held[slot] = (np.empty(0, np.int64),) * 2
        for slot, counts in held.items():
            yield given(slot, *counts)

    return run


def _added(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(values, kind="stable")
    values = values[order]
    at = _distinct(values)
    return values[at], np.add.reduceat(n[order], at) if len(at) else n[:0]


def _picked(ranks: list[list[int]]) -> Callable[[Batches], Batches]:
    """The values at the ranks wanted of each part."""

    def run(batches: Batches) -> Batches:
        held = defaultdict(list)
        for batch in batches:
            slots, value, n = (c.to_numpy() for c in batch.columns)
            for slot in np.unique(slots).tolist():
                held[slot].append((value[slots == slot], n[slots == slot]))
        for slot, counts in held.items():
            values, n = _added(*(np.concatenate(c) for c in zip(*counts, strict=True)))
            at = np.minimum(np.searchsorted(np.cumsum(n), ranks[slot]), len(values) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([slot] * len(at), pa.int32()), pa.array(ranks[slot], pa.int64()), pa.array(values[at])], names=["slot", "rank", "value"])

    return run


def summarise(df: DataFrame, rows: int, least: int, probs: dict[str, float], ranked: Sequence[str]) -> dict[str, dict]:
    """``distinct`` values, the ``least`` few and the quantiles ``probs`` of every column of a frame of bigints and doubles.

    Nulls are left out. A quantile is the value at rank ``floor((n - 1) * q + 0.5) + 1`` of the
    ``ranked`` columns' numbers, NaN left out. ``rows`` is the number of rows, to cut columns into
    parts. What comes back is a row for each column and part, at most MOST_PARTS of a column.
    """
    names, floating = df.columns, [kind == "double" for _, kind in df.dtypes]
    df = df.toDF(*[f"_{i}" for i in range(len(names))])  # a name may hold a dot
    cuts = _cuts(df, rows)
    parts = max(len(c) for c in cuts) + 1
    # an exchange by key would put several parts in one task
    dealt = df.mapInArrow(_tally(cuts, floating), "part int, `column` int, rows long, values array<long>").repartitionById(parts, "part")
    with by_rows(df.sparkSession):
        told = dealt.mapInArrow(_told_apart(least), "`column` long, part long, rows long, distinct long, least array<long>").toArrow().to_pylist()
    by_column = defaultdict(list)
    for row in sorted(told, key=lambda r: (r["column"], r["part"])):
        by_column[row["column"]].append(row)
    out, wanted = {}, {}
    for i, name in enumerate(names):
        own = by_column[i]
        low = np.array([v for r in own for v in r["least"]][:least], np.int64)
        out[name] = {"distinct": sum(r["distinct"] for r in own), "least": _restored(low, floating[i]).tolist(), **dict.fromkeys(probs)}
        total = sum(r["rows"] for r in own)
        if name not in ranked or not total:
            continue
        ends = np.cumsum([r["rows"] for r in own])
        for prob, q in probs.items():
            rank = int((total - 1) * q + 0.5) + 1
            at = int(np.searchsorted(ends, rank))
            part = own[at]["part"]
            first, last = _ordered(np.array([-np.inf, np.inf])).tolist() if floating[i] else (int(~_BITS), int(_BITS))
            low = int(cuts[i][part - 1]) if part else first
            high = min(last, int(cuts[i][part]) - 1) if part < len(cuts[i]) else last
            wanted.setdefault((i, low, high), {})[prob] = rank - int(ends[at] - own[at]["rows"])
    if wanted:
        slots = list(wanted)
        ranks = [sorted(set(w.values())) for w in wanted.values()]
        bounds = [(f"_{i}", _restored(np.array(ends), floating[i]).tolist()) for i, *ends in slots]
        near = df.where(reduce(Column.__or__, [F.col(c).between(*ends) for c, ends in bounds]))
        held = near.mapInArrow(_looked_into(slots), "slot int, value long, n long").repartitionById(len(slots), "slot")
        with by_rows(df.sparkSession):
            found = {(r["slot"], r["rank"]): r["value"] for r in held.mapInArrow(_picked(ranks), "slot int, rank long, value long").toArrow().to_pylist()}
        for slot, (key, of) in enumerate(wanted.items()):
            for prob, rank in of.items():
                out[names[key[0]]][prob] = float(_restored(np.array([found[slot, rank]], np.int64), floating[key[0]])[0])
    return out
