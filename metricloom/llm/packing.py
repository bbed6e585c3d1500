"""Packing: concatenate all token sequences and cut them at fixed windows.

First pass: every task tokenizes its rows, keeps a running sum of their tokens, and writes
(part, start within the part, ids). Prefix sums over the totals of the parts, one small row each,
give each part its place in the whole. Second pass: each row is cut where a window of `width`
tokens ends. No row moves between tasks; a text of any length is cut like any other, and all
sequences but the last are full, so nothing is padded but that one.

The tokenizer maps pieces of a text on their own, so ids are looked up by piece and only pieces
not seen lately are tokenized; a test compares this with whole texts.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from metricloom.llm import common

WIDTH, END = 2048, 1
#: Words kept per generation of a worker's lookup, if the caller names no number; two generations at most.
KNOWN = 400_000
#: Token ids of a text are written in rows of at most this many, so that no row grows with its text.
ROW = 1 << 20
_ID = attrgetter("id")
_SPACE = re.compile(r"[ \t\n\r]+")
# what the tokenizer itself splits at, for texts within the Latin blocks
_LETTERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u00ff\u0101-\u017f"
_DIGITS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
_PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\\s{_LETTERS}{_DIGITS}]+")
_OTHER = re.compile("[^\\x00-\\x1b\\x20-\u012f\u0131-\u017f]|<\\|")
# byte-level models write bytes as characters: those that print as themselves, the others as U+0100 and up in order
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}


class Lookup(dict):
    """Values made on demand and kept for a while: at most two generations of `known`."""

    def __init__(self, make, known: int):
        self.make, self.known, self.old = make, known, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.known:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


@lru_cache(1)
def _tokenizer(path: str):
    """Read once a worker, as reading takes as long as half a megabyte of text does; the words it has seen are a task's own."""
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordIds:
    """Token ids of texts as little-endian 32-bit runs, by a bounded lookup of words.

    The tokenizer folds case, splits a text at white space and between letters, digits and other
    characters, and maps each piece on its own. For texts within the Latin blocks the same split is
    done here; texts with other characters or with the names of special tokens go by words between
    white space, which the tokenizer splits itself.
    """

    def __init__(self, path: str, known: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        # a caller that bounds what is remembered has a worker hold no vocabulary either
        whole = _tokenizer.__wrapped__(path) if known else _tokenizer(path)
        known = known or KNOWN
        tokenize = whole.model.tokenize

        def latin(word: str) -> bytes:
            """The ids of a word's pieces; one that is its own only piece is left to the model alone, as the characters that stand for its bytes."""
            low = word.lower()
            # letters only, as most words are, is one piece
            pieces = [low] if low.isalpha() else _PIECE.findall(low)
            if pieces != [word]:
                return b"".join([self.latin[p] for p in pieces])
            shown = low if low.isascii() and low.isprintable() else low.encode().decode("latin-1").translate(_BYTES)
            return array("I", map(_ID, tokenize(shown))).tobytes()

        self.latin = Lookup(latin, known)
        self.words = Lookup(lambda word: array("I", whole.encode(word, add_special_tokens=False).ids).tobytes(), known)

    def __call__(self, texts: list[str]) -> list[bytes]:
        return [b"".join(map(self.words.__getitem__, _SPACE.split(t)) if _OTHER.search(t) else map(self.latin.__getitem__, t.split())) for t in texts]


def tokenized(docs: DataFrame, path: str, end: int = END, known: int | None = None) -> DataFrame:
    """(doc_id, part, at, start, doc_tokens, ids): ids of each document with `end` last, as 32-bit bytes.

    `at` is the offset within the part, `start` the offset within the document; long documents
    take several rows.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("at", pa.int64()), ("start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
    last = np.array([end], "<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        # of this task only: a worker that goes on to other work should not hold the words
        ids_of = WordIds(path, known)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            # blocks by length, so that a batch of long texts is not held as tokens at once
            sizes = np.array(pa.compute.fill_null(pa.compute.binary_length(texts), 0), np.int64)
            for lo, hi in common.blocks(np.concatenate([[0], np.cumsum(sizes)])):
                rows = []
                for key, ids in zip(keys.slice(lo, hi - lo).to_pylist(), ids_of([t or "" for t in texts.slice(lo, hi - lo).to_pylist()]), strict=True):
                    ids += last
                    for start in range(0, len(ids) // 4, ROW):
                        piece = ids[4 * start: 4 * (start + ROW)]
                        rows.append((key, part, at, start, len(ids) // 4, piece))
                        at += len(piece) // 4
                yield common.batch_of(rows, schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(
        encode, "doc_id long, part int, at long, start long, doc_tokens long, ids binary")


def packed(docs: DataFrame, path: str, width: int = WIDTH, end: int = END, known: int | None = None) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (32-bit little-endian bytes).

    `known` words are remembered by a worker (KNOWN if none is named): fewer take less memory and more time, the ids are the same.

    Defined results: a null or empty text is the end token alone; a null doc_id stays null; rows
    that repeat a doc_id are packed each on its own; other columns are ignored; no rows, no pieces.
    """
    rows = common.settle(tokenized(docs, path, end, known))
    # one row per task of the first pass
    totals = rows.groupBy("part").agg(F.sum(F.length("ids") / 4).cast("long").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    base = totals.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
                        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out = []
                for key, at, start, total, ids in zip(*(batch.column(i).slice(lo, 256).to_pylist() for i in range(5)), strict=True):
                    n, done = len(ids) // 4, 0
                    while done < n:
                        offset = (at + done) % width
                        take = min(n - done, width - offset)
                        piece = ids[4 * done: 4 * (done + take)]
                        out.append((key, start + done, take, zlib.crc32(piece), total, (at + done) // width, offset, piece))
                        done += take
                yield common.batch_of(out, schema)

    placed = rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("at")).alias("at"), "start", "doc_tokens", "ids")
    return placed.mapInArrow(cut, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


def sequences(pieces: DataFrame, width: int = WIDTH, pad: int = 0) -> DataFrame:
    """(sequence_id, ids, tokens): the windows themselves, each gathered from at most `width` pieces and padded."""
    ordered = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"), F.sum("length").alias("tokens"))
    filled = F.expr(f"rpad(aggregate(p.ids, cast('' as binary), (a, x) -> a || x), {4 * width}, unhex('{pad.to_bytes(4, 'little').hex()}'))")
    return ordered.select("sequence_id", filled.alias("ids"), "tokens")
