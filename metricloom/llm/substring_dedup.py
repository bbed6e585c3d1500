"""Substring dedup by seed and extend: repeated runs of words across and within documents.

Seeds are winnowed anchors: of every 20 words, the 6-word run with the smallest hash. Documents
join on their anchors. A seed is extended both ways as far as a window that holds it reaches;
where the whole neighbourhood is alike the match goes on to the next anchor, where it is not
(`repeats.opened`) the windows are compared one by one, which finds the end of the match to the
word. Adjoining matches make the maximal repeats; none is shorter than `window` words.

Defined results: a null or empty text has no words; a null doc_id counts as the smallest and is
returned as null; rows that repeat a doc_id are one document, with the largest of their texts;
other columns are ignored. A text of any length is read whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from metricloom.llm import common, repeats

WINDOW = 20
ANCHOR = 6


def _units(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, _, hashes, first = common.words(body, offsets)
    return hashes, first


def cut(window: int = WINDOW, anchor: int = ANCHOR) -> repeats.Units:
    return repeats.Units(_units, window, anchor)


def maximal_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, text, spans) with the windows of each document that also start earlier."""
    docs, units = common.keyed(docs), cut(window, anchor)
    found = repeats.repeated(docs, units, lambda u, start: repeats.window_digests(u, start, window))
    return repeats.with_spans(docs, found)


def substring_dedup(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Kept words of every document: doc_id, n_words, n_removed, n_spans, kept_text (words joined by one space)."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                        ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def trim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = text.as_buffer().to_pybytes().split()  # bytes split at 0x20 and 0x09-0x0D only
                total, runs = len(words), 0
                if spans.is_valid:
                    out = repeats.covered(spans, total, window)
                    runs = int(np.count_nonzero(np.diff(np.concatenate([[False], out]).astype(np.int8)) == 1))
                    words = [words[i] for i in np.flatnonzero(~out)]
                kept = b" ".join(words)
                rows.append((key, total, total - len(words), runs, hashlib.sha256(kept).hexdigest(), kept.decode()))
            yield common.batch_of(rows, schema)

    out = maximal_repeats(docs, window, anchor).mapInArrow(
        trim, "doc_id long, n_words long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
    return common.unkeyed(out, "doc_id")
