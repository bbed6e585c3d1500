"""Phrase collocations by prefix-free parsing: n-grams are counted once per distinct chunk of the corpus.

A text is split into pieces at punctuation and line ends, and pieces into words. A piece is cut
where the hash of MOST - 1 words in a row is a multiple of MODULUS: such a trigger ends one chunk
and begins the next, so neighbours overlap by MOST - 1 words, and where a chunk is cut depends on
its words alone. The distinct chunks of a language form the dictionary, their numbers in the parse
its frequencies. Every phrase of up to MOST words lies whole in the chunk that owns its first word:
a chunk owns all its words but the overlap with the next. So phrases that begin at an owned word
are counted, times the chunk's frequency, and those of overlaps once. A passage that the corpus
repeats is counted as often as its chunks differ, not as often as it stands there.

Counts are taken in three passes over the dictionary: words, pairs, and phrases of three words and
more. A phrase is as frequent as `least` only if its words are, and its pairs, so the second and
third pass leave out what cannot be. They know by a bitmap of fixed size over hashes of the
frequent words or pairs; it holds no frequent one back, and the counts of those it lets through in
excess are dropped by the threshold. All counts are of phrases themselves, not of hashes.

Defined results: a null text is empty, a null language is `und`; texts without words add nothing;
repeated rows count as often as they stand there; a text or word of any length is read whole; other
columns are ignored; no rows, no phrases. Ties are settled as the columns of the order say, and
by the bytes of the phrase last. Products are decimals of 38 digits, which hold corpora of up to
10^17 words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from metricloom.llm import common

MOST, LEAST, COVER, TOP = 5, 100, 100, 2000
#: One word window in this many is a trigger, other than in repetitive text.
MODULUS = 16
#: Bits of the filter of frequent words or pairs; its size is fixed, more of them only make it less selective.
BITS = 1 << 25
#: Bytes of chunks that are counted in one step of a task.
STEP = 1 << 20
_UNKNOWN = "und"
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?\n\x0b\x0c\r"]] = True
_GAP[[*b".,;:!?\n\x0b\x0c\r \t"]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _strings(body: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.StringArray:
    """The spans of a text as an array of strings."""
    offsets = np.zeros(len(start) + 1, np.int64)
    np.cumsum(end - start, out=offsets[1:])
    data = body[np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(data)).cast(pa.string())


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks (lang, chunk, last) of (lang, text): words joined by one space; `last` where a chunk ends its piece."""
    over = MOST - 1
    for batch in batches:
        lang = batch.column(0)
        whole, bounds = common.texts(batch)
        for lo, hi in common.blocks(bounds):
            body, offsets = _FOLD[whole[bounds[lo]: bounds[hi]]], bounds[lo: hi + 1] - bounds[lo]
            start, end, hashes, first = common.words(body, offsets, gaps=_GAP)
            if not len(start):
                continue
            # a piece begins with a text, or after a break
            breaks = np.concatenate([[0], np.cumsum(_BREAK[body])])
            opens = np.ones(len(start), bool)
            opens[1:] = breaks[start[1:]] != breaks[end[:-1]]
            opens[first[first < len(start)]] = True
            piece_of = np.cumsum(opens) - 1
            closes = np.append(np.flatnonzero(opens)[1:], len(start))[piece_of]
            cuts = opens.copy()
            window = common.gram_hash(hashes, over)
            at = np.arange(len(window))
            cuts[: len(window)] |= (window % np.uint64(MODULUS) == 0) & (at + over <= closes[: len(window)])
            left = np.flatnonzero(cuts)
            right = np.append(left[1:], len(start))
            last = right == closes[left]
            right = np.where(last, right, right + over)
            # the words again with one space after each
            size = end - start + 1
            place = np.concatenate([[0], np.cumsum(size)])
            tidy = np.full(place[-1], 32, np.uint8)
            spread = np.arange(place[-1]) - np.repeat(place[:-1], size)
            inside = spread < np.repeat(size - 1, size)
            tidy[inside] = body[(np.repeat(start, size) + spread)[inside]]
            document = np.searchsorted(first, left, "right") - 1
            yield pa.RecordBatch.from_arrays([lang.take(pa.array(lo + document)), _strings(tidy, place[left], place[right] - 1), pa.array(last)], names=["lang", "chunk", "last"])


def parse(docs: DataFrame) -> DataFrame:
    """The dictionary: (lang, chunk, last, n), the distinct chunks of each language and how often the parse holds them."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(_UNKNOWN)).alias("lang")
    chunks = docs.select(lang, F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(_cut, "lang string, chunk string, last boolean")
    return chunks.groupBy("lang", "chunk", "last").agg(F.count("*").alias("n"))


_POWERS = common.Powers(0x9E3779B97F4A7C15)


def _bits(lang: pa.Array, body: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The filter bit of each span, by its language and its bytes."""
    encoded = lang.dictionary_encode()
    salts = np.array([int.from_bytes(hashlib.blake2b(v.encode(), digest_size=8).digest()) for v in encoded.dictionary.to_pylist()], np.uint64)
    salt = salts[encoded.indices.to_numpy()]
    sums = _POWERS.sums(common.byte_units(body))
    return (common.mix(_POWERS.spans(sums, start, end) ^ salt[row]) % np.uint64(BITS)).astype(np.int64)


def _filter_of(frequent: DataFrame) -> np.ndarray:
    """The bitmap of frequent phrases (lang, phrase)."""

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = common.texts(batch, "phrase")
            yield pa.RecordBatch.from_arrays([pa.array(_bits(batch.column(0), body, offsets[:-1], offsets[1:], np.arange(batch.num_rows)))], names=["bit"])

    width = 8 * 4096
    rows = (frequent.select("lang", "phrase").mapInArrow(bits, "bit long").groupBy(F.expr(f"bit div {width}").alias("part"))
            .agg(F.expr(f"bitmap_construct_agg(bit % {width})").alias("bits")).collect())
    out = np.zeros(BITS // 8, np.uint8)
    for part, some in rows:
        out[part * 4096: part * 4096 + len(some)] = np.frombuffer(some, np.uint8)
    return out


def _counts(chunks: DataFrame, sizes: range, known: np.ndarray | None = None) -> DataFrame:
    """(lang, phrase, a): occurrences of phrases of `sizes` words; with words alone, also all words under a null phrase.

    `known` is the filter of frequent words for pairs, and of frequent pairs for longer phrases.
    """
    unit = 1 if sizes[0] == 2 else 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, last, times = batch.column(0), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            whole, bounds = common.texts(batch, "chunk")
            for lo, hi in common.blocks(bounds, STEP):
                body, offsets = whole[bounds[lo]: bounds[hi]], bounds[lo: hi + 1] - bounds[lo]
                begins = np.zeros(len(body) + 1, bool)
                begins[1:][body == 32] = True
                begins[offsets[:-1]] = True
                start = np.flatnonzero(begins[:-1])
                row = np.searchsorted(offsets, start, "right") - 1
                stop = np.searchsorted(start, offsets)  # first word of each chunk
                end = np.append(start[1:] - 1, len(body))
                closing = stop[1:] - 1
                end[closing] = offsets[1:]
                left = stop[row + 1] - np.arange(len(start))  # words from here to the chunk's end
                owned = left > np.where(last[lo:hi], 0, MOST - 1)[row]
                names, out = lang.slice(lo, hi - lo), []
                if known is not None:
                    here = np.flatnonzero(left >= unit)
                    bit = _bits(names, body, start[here], end[here + unit - 1], row[here])
                    common_here = np.zeros(len(start) + MOST, bool)
                    common_here[here] = known[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
                for size in sizes:
                    take = owned & (left >= size)
                    if known is not None:
                        for step in range(size - unit + 1):
                            take &= common_here[step: step + len(start)]
                    at = np.flatnonzero(take)
                    if len(at):
                        out.append((names.take(pa.array(row[at])), _strings(body, start[at], end[at + size - 1]), times[lo + row[at]]))
                if known is None:
                    words = np.bincount(row[owned], minlength=hi - lo) * times[lo:hi]
                    out.append((names, pa.nulls(hi - lo, pa.string()), words))
                if out:
                    table = pa.table({"lang": pa.concat_arrays([o[0] for o in out]), "phrase": pa.concat_arrays([o[1] for o in out]), "a": np.concatenate([o[2] for o in out])})
                    # ahead of the exchange, equal phrases of a step are one row
                    table = table.group_by(["lang", "phrase"], use_threads=False).aggregate([("a", "sum")]).rename_columns({"a_sum": "a"})
                    yield from table.select(["lang", "phrase", "a"]).combine_chunks().to_batches()

    return chunks.select("lang", "chunk", "last", "n").mapInArrow(count, "lang string, phrase string, a long").groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def frequencies(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, a) of the phrases of up to MOST words found `least` times or more, and (lang, n) of all words."""
    chunks = common.settle(parse(docs))
    words = common.settle(_counts(chunks, range(1, 2)).where(f"phrase is null or a >= {int(least)}"))
    totals = words.where("phrase is null").select("lang", F.col("a").alias("n"))
    words = words.where("phrase is not null")
    pairs = common.settle(_counts(chunks, range(2, 3), _filter_of(words)).where(f"a >= {int(least)}"))
    longer = common.settle(_counts(chunks, range(3, MOST + 1), _filter_of(pairs)).where(f"a >= {int(least)}"))
    return words.unionByName(pairs).unionByName(longer), totals


def collocations(docs: DataFrame, least: int = LEAST, cover: int = COVER, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language that hold together best.

    A phrase goes if a longer one that is as frequent as `least` holds it and has `cover` percent of its occurrences.
    """
    found, totals = frequencies(docs, least)
    phrases = found.where("instr(phrase, ' ') > 0").withColumn("w", F.split("phrase", " "))
    part = "array_join(slice(w, {}, {}), ' ')"
    cuts = phrases.select("lang", "phrase", "a", "w", F.explode(F.expr("sequence(1, size(w) - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", F.expr(part.format(1, "k")).alias("head"), F.expr(part.format("k + 1", "size(w) - k")).alias("rest"))
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    rests = found.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    big = "cast({} as decimal(19, 0))"
    score = F.expr(f"({big.format('a')} * {big.format('n')} * 1000bd) div ({big.format('l')} * {big.format('r')})").alias("score")
    scored = (cuts.join(heads, ["lang", "head"]).join(rests, ["lang", "rest"]).join(totals, "lang")
              .select("lang", "phrase", "a", "n", F.struct(score, "k", "l", "r").alias("cut"))
              .groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut")))
    inner = phrases.where("size(w) > 2").select("lang", "a", "w", F.explode(F.expr("sequence(2, size(w) - 1)")).alias("size"))
    inner = inner.select("lang", "a", "w", "size", F.explode(F.expr("sequence(1, size(w) - size + 1)")).alias("at"))
    covered = inner.groupBy("lang", F.expr(part.format("at", "size")).alias("phrase")).agg(F.max("a").alias("inside"))
    best = scored.join(covered, ["lang", "phrase"], "left").where(f"inside is null or 100 * inside < {int(cover)} * a")
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    return best.withColumn("rank", rank).where(F.col("rank") <= top).select(
        "lang", F.col("rank").cast("long"), "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
