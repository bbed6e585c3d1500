"""Helpers the corpus operators share: document keys, hashing of units in bulk, bounded id filters."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metricloom import session

__all__ = ["BLOCK", "PUNCTUATION", "Powers", "batch_of", "bit_filter", "blocks", "byte_units", "each_row", "gram_hash", "id_bit", "keyed", "mix", "rowed", "settle", "texts", "unkeyed", "words"]

NO_ID = -(2**63)
#: Bytes of text that one vectorised step handles; a longer text is a step of its own.
BLOCK = 1 << 18
#: Bits of an id filter: its size is fixed, more ids only make it less selective.
FILTER_BITS = 1 << 23

_random = np.random.default_rng(20240229)
_BYTE = _random.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = _BYTE.copy()
_FOLD[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def settle(df: DataFrame) -> DataFrame:
    """Written as the session writes: these operators were measured so."""
    return session.settle(df, None)


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with one row per document: a null text is empty, a null id the smallest id.

    Rows that repeat a doc_id are one document, whose text is the largest of theirs. Whether any
    do is a count over the ids alone; without repeats the texts are not moved. The queries and the
    pipeline give every row an id of its own first (`rowed`), so that each text is judged.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))
    again = rows.groupBy("doc_id").count().where("count > 1")
    return rows if again.isEmpty() else rows.groupBy("doc_id").agg(F.max("text").alias("text"))


def rowed(docs: DataFrame) -> tuple[DataFrame, bool]:
    """The rows with a doc_id that none shares and their own as `_doc`; and whether any did share one, nulls included.

    New ids are in the order of the old ones, null first, and are written, so that they stay.
    """
    again = docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).count().where("count > 1")
    rows = docs.withColumn("_doc", F.col("doc_id").cast("long"))
    if again.isEmpty():
        return rows, False
    # the second key spreads an id with very many rows over tasks
    rows = rows.withColumn("_tie", F.monotonically_increasing_id()).orderBy("_doc", "_tie").drop("_tie")
    return settle(rows.withColumn("doc_id", F.monotonically_increasing_id())), True


def each_row(operator: Callable[[DataFrame], DataFrame], docs: DataFrame, *names: str) -> DataFrame:
    """An operator over documents with every row a document of its own; the ids under `names` are given back."""
    rows, changed = rowed(docs)
    out = operator(rows)
    for name in names if changed else ():
        own = rows.select(F.col("doc_id").alias("_row"), "_doc")
        out = out.join(own, F.col(name) == F.col("_row"), "left").withColumn(name, F.col("_doc")).drop("_row", "_doc")
    return out


def unkeyed(df: DataFrame, *names: str) -> DataFrame:
    """Give null ids back."""
    return df.withColumns({n: F.when(F.col(n) != NO_ID, F.col(n)) for n in names})


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2^64, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base | 1, pow(base | 1, -1, 2**64)
        self.up = self.down = np.ones(1, np.uint64)

    def sums(self, units: np.ndarray) -> np.ndarray:
        """Prefix sums of units[i] * base^i, one more than there are units."""
        if len(self.up) <= len(units):
            size = 1 << (len(units) + 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
        out = np.zeros(len(units) + 1, np.uint64)
        np.cumsum(units * self.up[: len(units)], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of units[start:end], the same wherever the span stands."""
        return mix((sums[end] - sums[start]) * self.down[start])


_WORDS = Powers(0x9E3779B97F4A7C15)
_GRAMS = Powers(0xC2B2AE3D27D4EB4F)


def texts(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text column end to end, and where each row's begin (one more at the end)."""
    column = batch.column(batch.schema.get_field_index(name))
    if pa.types.is_large_string(column.type) or column.null_count or column.offset:
        column = pa.concat_arrays([column.cast(pa.large_string()).fill_null("")])
        offsets = np.frombuffer(column.buffers()[1], np.int64)
    else:
        offsets = np.frombuffer(column.buffers()[1], np.int32)
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = offsets[: len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    body = np.frombuffer(data, np.uint8)[offsets[0]: offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return body, offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts together hold about `size` bytes, one row at least."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        to = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, to
        row = to


def words(body: np.ndarray, offsets: np.ndarray, fold: bool = False, gaps: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts laid end to end: starts, ends, hashes, and each text's first word (one more at the end).

    A word is a run of bytes other than `gaps`: space and 0x09-0x0D, or PUNCTUATION, all ASCII
    but letters and digits. `fold` hashes A-Z as a-z.
    """
    solid = ~gaps[body]
    before, after = np.zeros(len(body), bool), np.zeros(len(body), bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    edges = offsets[(offsets > 0) & (offsets < len(body))]
    before[edges], after[edges - 1] = False, False
    start, end = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
    hashes = _WORDS.spans(_WORDS.sums((_FOLD if fold else _BYTE)[body]), start, end)
    return start, end, hashes, np.searchsorted(start, offsets)


def gram_hash(units: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n units; runs over the edge of a text are the caller's to leave out."""
    if len(units) < n:
        return np.empty(0, np.uint64)
    at = np.arange(len(units) - n + 1)
    return _GRAMS.spans(_GRAMS.sums(units), at, at + n)


def byte_units(body: np.ndarray) -> np.ndarray:
    return _BYTE[body]


def id_bit(name: str):
    """The bit of an id filter that stands for an id."""
    return F.pmod(F.xxhash64(name), F.lit(FILTER_BITS))


def bit_filter(ids: DataFrame, name: str) -> np.ndarray:
    """A bitmap of hashed ids of fixed size (FILTER_BITS), to skip most rows that a join would drop.

    It lets some other rows through, never holds one back, and does not grow with the data.
    """
    width = 8 * 4096
    rows = (ids.select(id_bit(name).alias("bit")).groupBy(F.expr(f"bit div {width}").alias("part"))
            .agg(F.expr(f"bitmap_construct_agg(bit % {width})").alias("bits")).collect())
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for part, bits in rows:
        out[part * 4096: part * 4096 + len(bits)] = np.frombuffer(bits, np.uint8)
    return out


def batch_of(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as one Arrow batch."""
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
