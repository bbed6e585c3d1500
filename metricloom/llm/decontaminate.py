"""Benchmark decontamination: near copies of benchmark items in item-sized windows of documents.

Texts are runs of words (case of A-Z and ASCII punctuation aside). A document leaks an item of L
words if a window of L of its words is within floor(0.2 L) word edits of the item. At the borders
of a document windows are cut off, so a document that is an item less some words leaks it too.

1. Exact filter: such a window has all but a few of the words that tell the item from others, and
   one of them in its place, give or take the edits. Other windows are left out without loss.
2. CGK embedding: a random walk over the window writes the current word at each step and moves on
   or stays by a random bit of (step, word). Walks over texts that differ by a few edits meet
   again soon, so edit distance becomes Hamming distance.
3. Bit sampling: 24 times, 4 coordinates of the embedding make a key; windows that share keys with
   the item are verified first, those with most keys ahead, as a near window bounds all others of
   its text. Few windows of a long item share a key with it at the full distance, so keys set the
   order alone and drop no window.
4. All windows are verified: by the number of their words that the item has, which bounds the
   distance, and what that leaves by exact word edit distance. Every leak is found.

The benchmark is the query set: it is counted first and sent to the tasks in blocks of bounded
size (`BLOCK_WORDS`), each against all documents. Documents are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metricloom.llm import common

TOLERANCE, DRAWS, SAMPLED = 0.2, 24, 4
#: Items shorter than this have no tolerance: an edited copy of a few common words is everywhere.
LEAST = 8
#: Bytes of benchmark text that one block holds at most (an item is never split).
BLOCK_BYTES = 8 << 20
#: Words of windows that are looked at in one step.
GRID = 1 << 21


def allowed(length: int, tolerance: float = TOLERANCE) -> int:
    return int(length * tolerance)


def item_words(text: str | bytes) -> np.ndarray:
    body = np.frombuffer(text if isinstance(text, bytes) else text.encode(), np.uint8)
    return common.words(body, np.array([0, len(body)]), fold=True, gaps=common.PUNCTUATION)[2]


def sampled_keys(windows: np.ndarray, draws: int, sampled: int) -> np.ndarray:
    """(windows, draws) keys: hashes of the sampled coordinates of the CGK walks over the windows.

    A walk writes its current word at each step and moves on by a random bit of (draw, step, word);
    past its end it writes 0. Only the steps up to the last sampled coordinate are walked.
    """
    rows, length = windows.shape
    random = np.random.default_rng((20240607, length))
    coins = random.integers(1, 2**63, (3 * length, draws), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    wanted = np.zeros((3 * length, draws), bool)
    for draw in range(draws):
        wanted[random.choice(2 * length, min(sampled, 2 * length), replace=False), draw] = True
    padded = np.concatenate([windows, np.zeros((rows, 1), np.uint64)], axis=1)
    at, every = np.zeros((rows, draws), np.int64), np.arange(rows)[:, None]
    key = np.zeros((rows, draws), np.uint64)
    for step in range(2 * length):
        word = padded[every, at]
        key = np.where(wanted[step], common.mix(key * np.uint64(0x9E3779B97F4A7C15) + word + np.uint64(step)), key)
        at = np.minimum(at + ((word * coins[step]) >> np.uint64(63)).astype(np.int64), length)
    return key


def word_masks(words: list) -> dict:
    """The places of each word as the bits of one number."""
    masks: dict = {}
    for at, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << at
    return masks


def edit_distance(masks: dict, length: int, words: list, most: int) -> int:
    """Word edit distance from the text of `length` words with these masks, or most + 1 if it is larger.

    Bit-parallel: a column of the table is kept as the bits of its steps up and down.
    """
    full, last = (1 << length) - 1, 1 << (length - 1)
    up, down, far = full, 0, length
    for left, word in zip(range(len(words) - 1, -1, -1), words, strict=True):
        same = masks.get(word, 0)
        across = ((((same & up) + up) ^ up) | same | down) & full
        rise, fall = down | (full & ~(across | up)), up & across
        if rise & last:
            far += 1
        elif fall & last:
            far -= 1
        if far - left > most:
            return most + 1
        rise, fall = rise << 1 | 1, fall << 1
        up, down = (fall | ~(across | rise)) & full, rise & across
    return min(far, most + 1)


class Items:
    """A block of benchmark items: an index of their words, and their sampled keys by length."""

    def __init__(self, ids: list[int], texts: list[str], tolerance: float, draws: int, sampled: int, short: bool = False):
        self.draws, self.sampled = draws, sampled
        own = [(i, w) for i, w in ((i, item_words(t)) for i, t in zip(ids, texts, strict=True)) if len(w) >= (1 if short else LEAST)]
        self.ids, self.words = [i for i, _ in own], [w for _, w in own]
        self.length = np.array([len(w) for w in self.words], np.int64)
        self.most = np.array([allowed(len(w), tolerance) if len(w) >= LEAST else 0 for w in self.words], np.int64)
        if not own:
            return
        self.masks = [word_masks(w.tolist()) for w in self.words]
        # an item is looked for by the words no other item of the block has, if more than the edits, or else by all
        known, times = np.unique(np.concatenate([np.unique(w) for w in self.words]), return_counts=True)
        alone, entries, self.need = set(known[times == 1].tolist()), [], np.ones(len(own), np.int64)
        for k, w in enumerate(self.words):
            rare = [j for j, x in enumerate(w.tolist()) if x in alone]
            use = rare if len({int(w[j]) for j in rare}) > self.most[k] else range(len(w))
            self.need[k] = max(1, len({int(w[j]) for j in use}) - self.most[k])
            entries += [(int(w[j]), k, j) for j in use]
        word = np.array([e[0] for e in entries], np.uint64)
        order = np.argsort(word, kind="stable")
        self.vocabulary, self.begin = np.unique(word[order], return_index=True)
        self.begin = np.append(self.begin, len(order))
        self.entry_item = np.array([e[1] for e in entries], np.int64)[order]
        self.entry_at = np.array([e[2] for e in entries], np.int64)[order]
        self.keys: list = [None] * len(own)
        for n in np.unique(self.length):
            same = np.flatnonzero(self.length == n)
            for k, key in zip(same, sampled_keys(np.array([self.words[k] for k in same]), draws, sampled), strict=True):
                self.keys[k] = key

    def windows(self, words: np.ndarray, first: np.ndarray) -> np.ndarray:
        """(item, start, words) of all windows that can be near an item, in a block of texts.

        A window within e edits of an item has all but e of the words the item is looked for by,
        and one of them stands where the item has it, give or take e places. What a window has
        beyond a border of its text is cut off; that many edits at least are spent then.
        """
        place = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        at = np.flatnonzero(self.vocabulary[place] == words)
        lo = self.begin[place[at]]
        n = self.begin[place[at] + 1] - lo
        entry = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(at) else np.empty(0, np.int64)
        at = np.repeat(at, n)
        item, offset = self.entry_item[entry], self.entry_at[entry]
        order = np.lexsort((at, item))
        at, item, offset = at[order], item[order], offset[order]
        code = item << 40 | at
        reach = np.searchsorted(code, code + self.length[item]) - np.arange(len(code))
        good = np.flatnonzero(reach >= self.need[item])
        edge = np.zeros(len(code) + 1, np.int64)
        np.add.at(edge, good, 1)
        np.add.at(edge, good + reach[good], -1)
        hit = np.flatnonzero(np.cumsum(edge)[:-1] > 0)
        text = np.searchsorted(first, at[hit], "right") - 1
        found = np.unique(np.stack([item[hit], text, at[hit] - offset[hit]]), axis=1)
        slack = self.most[found[0]]
        step = np.repeat(-slack - np.concatenate([[0], np.cumsum(2 * slack + 1)[:-1]]), 2 * slack + 1) + np.arange((2 * slack + 1).sum()) if found.shape[1] else np.empty(0, np.int64)
        found = np.repeat(found, 2 * slack + 1, axis=1)
        start = found[2] + step
        lo = np.maximum(start, first[found[1]])
        size = np.minimum(start + self.length[found[0]], first[found[1] + 1]) - lo
        return np.unique(np.stack([found[0], lo, size])[:, size >= self.length[found[0]] - self.most[found[0]]], axis=1)

    def possible(self, own: np.ndarray, grid: np.ndarray, item: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The windows, and their words, with so many words of their item that they can be near it: each other word is an edit."""
        good = np.zeros(len(own), bool)
        for k in np.unique(item[own]):
            mine = np.flatnonzero(item[own] == k)
            good[mine] = np.isin(grid[mine], self.words[k]).sum(axis=1) >= self.length[k] - self.most[k]
        return own[good], grid[good]

    def near(self, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """(text, item, start, length, distance) of the best window per text and item of a block of texts."""
        if not self.ids or not len(words):
            return
        item, start, size = self.windows(words, first)
        # places past the end of a cut window hold 0, which is no word
        words = np.append(words, np.uint64(0))
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n in np.unique(self.length[item]):
            same = np.flatnonzero(self.length[item] == n)
            for lo in range(0, len(same), max(1, GRID // n)):
                own = same[lo: lo + max(1, GRID // n)]
                place = np.arange(n)
                grid = words[np.where(place < size[own][:, None], start[own][:, None] + place, -1)]
                own, grid = self.possible(own, grid, item)
                alike = (sampled_keys(grid, self.draws, self.sampled) == np.array([self.keys[k] for k in item[own]]).reshape(len(own), self.draws)).sum(axis=1)
                for j in np.argsort(-alike, kind="stable"):
                    k, at = int(item[own[j]]), int(start[own[j]])
                    pair = (int(np.searchsorted(first, at, "right") - 1), k)
                    # of windows at one distance the first counts, whatever shares a step with them
                    most = int(self.most[k]) if pair not in best else best[pair][1] - (at > best[pair][0])
                    if most >= 0 and (far := edit_distance(self.masks[k], int(n), grid[j, : size[own[j]]].tolist(), most)) <= most:
                        best[pair] = (at, far)
        for (text, k), (at, far) in sorted(best.items()):
            yield text, self.ids[k], at - int(first[text]), int(self.length[k]), far


def item_blocks(benchmark: DataFrame, size: int = BLOCK_BYTES) -> Iterator[tuple[list[int], list[str]]]:
    """The benchmark in blocks of about `size` bytes of text; how many is found by counting first."""
    items = benchmark.where("item_id is not null").select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-2 * total // size)) if total > size else 1
    for part in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part).collect()
        yield [r.item_id for r in rows], [r.text for r in rows]


def contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, draws: int = DRAWS, sampled: int = SAMPLED, short: bool = False) -> DataFrame:
    """doc_id, item_id, start_word, item_words, distance: every document and item it leaks, at its best window, the first of equals.

    Defined results: null or empty texts leak nothing, nor do texts shorter than an item by more
    than the edits; a window at a border of a document may be shorter than its item; items with
    fewer than 8 words are searched by exact match if `short`, as the queries do, and left out
    otherwise; items without words or an id are left out; a null doc_id stays null; repeated rows
    give a row each; other columns are ignored. A text of any length is searched whole.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("item_words", pa.int64()), ("distance", pa.int64())])

    def search(ids: list[int], texts: list[str]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = Items(ids, texts, tolerance, draws, sampled, short)
            for batch in batches:
                body, offsets = common.texts(batch)
                keys, out = batch.column(0).to_pylist(), []
                for lo, hi in common.blocks(offsets, 4 * common.BLOCK):
                    _, _, words, first = common.words(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], fold=True, gaps=common.PUNCTUATION)
                    out += [(keys[lo + text], *rest) for text, *rest in items.near(words, first)]
                yield common.batch_of(out, schema)
        return run

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    found = None
    for ids, texts in item_blocks(benchmark):
        part = rows.mapInArrow(search(ids, texts), "doc_id long, item_id long, start_word long, item_words long, distance long")
        found = part if found is None else found.unionByName(part)
    return found
