"""Language-model scoring by cross-entropy difference.

A background model of the whole corpus and a target model of good text share one vocabulary, one
order (word bigrams) and one smoothing; the background's counts are scaled to the target's number
of tokens, so that the models match in size too. A document's score is the mean over its tokens
of the target's loss less the background's: below zero it is more like the target.

Nothing is capped: the vocabulary is all words of the corpus, the target all text labelled good,
and the counts of (previous word, word) are a table that grows with the corpus, combined per task
before it is moved. Words are told apart by 64-bit hashes, pairs by the hashes of both words. The
losses of each pair are worked out once, in that table. Each document's distinct pairs are joined
to it, but for pairs with one in `HOT` of all tokens or more: of those there are at most `HOT`,
and tasks have them at hand, so that no pair's rows meet in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from metricloom.llm import common

#: Share of all tokens (one in so many) from which a pair's losses are sent to the tasks.
HOT = 1 << 16
#: Bytes of text whose pairs are combined at once.
COMBINED = 1 << 22
#: Weight of the unigram model in a bigram's probability, in tokens; counts added to every word.
WEIGHT, ADDED = 100.0, 0.5
#: The previous word of a text's first.
START = 0


def bigrams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Previous word of each token, the token's word, and its text, of a block of texts."""
    _, _, words, first = common.words(body, offsets, fold=True)
    word, before = words.view(np.int64), np.empty(len(words), np.int64)
    before[1:] = word[:-1]
    before[first[:-1][np.diff(first) > 0]] = START
    return before, word, np.repeat(np.arange(len(first) - 1), np.diff(first))


def distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where each distinct row begins in it."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0) if len(order) else False
    return order, np.flatnonzero(new)


def pair_counts(docs: DataFrame) -> DataFrame:
    """(before, word, corpus, target): counts of pairs in all texts and in those that are `good`."""
    schema = pa.schema([(c, pa.int64()) for c in ("before", "word", "corpus", "target")])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = common.texts(batch)
            good = batch.column(1).to_numpy(zero_copy_only=False)
            for begin, end in common.blocks(offsets, COMBINED):
                found = []
                for lo, hi in common.blocks(offsets[begin: end + 1]):
                    lo, hi = lo + begin, hi + begin
                    before, word, text = bigrams(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                    found.append((before, word, good[lo + text].astype(np.int64)))
                before, word, own = (np.concatenate(c) for c in zip(*found, strict=True))
                order, at = distinct(word, before)
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(before[order[at]]), pa.array(word[order[at]]), pa.array(np.diff(np.append(at, len(order)))),
                                                      pa.array(np.add.reduceat(own[order], at))], schema=schema)

    return (docs.select("text", "good").mapInArrow(count, "before long, word long, corpus long, target long")
            .groupBy("before", "word").agg(F.sum("corpus").alias("corpus"), F.sum("target").alias("target")))


def pair_losses(pairs: DataFrame) -> DataFrame:
    """(before, word, corpus, of_target, of_background): losses of a word after another, in both models, of all pairs.

    Without target text the two are alike.
    """
    words = common.settle(pairs.groupBy("word").agg(F.sum("corpus").alias("n_corpus"), F.sum("target").alias("n_target")))
    size, tokens, good = words.agg(F.count("*"), F.coalesce(F.sum("n_corpus"), F.lit(0)), F.coalesce(F.sum("n_target"), F.lit(0))).first()
    starts = pairs.where(F.col("before") == START).agg(F.coalesce(F.sum("corpus"), F.lit(0)).alias("n_corpus"), F.coalesce(F.sum("target"), F.lit(0)).alias("n_target"))
    previous = words.unionByName(starts.select(F.lit(START).cast("long").alias("word"), "n_corpus", "n_target"))
    previous = previous.select(F.col("word").alias("before"), F.col("n_corpus").alias("b_corpus"), F.col("n_target").alias("b_target"))
    scale = good / tokens if good else 1.0

    def loss(kind: str, by: float):
        # one word more than there are: a word that the corpus doesn't have
        single = (F.col(f"n_{kind}") * by + ADDED) / ((good or tokens) + ADDED * (size + 1))
        return -F.ln((F.col(kind) * by + WEIGHT * single) / (F.col(f"b_{kind}") * by + WEIGHT))

    return pairs.join(words, "word").join(previous, "before").select(
        "before", "word", "corpus", loss("target" if good else "corpus", 1.0).alias("of_target"), loss("corpus", scale).alias("of_background"))


def scored(docs: DataFrame, labels: DataFrame, cells: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_unknown, target_loss, background_loss, score (per token, in nats) of every row.

    Defined results: a null or empty text has no tokens and null losses and score; a null doc_id
    stays null and is never a target; repeated rows are scored and counted each; labels of ids
    that are not there do nothing; without target text every score is 0; other columns are
    ignored. As all words are known, n_unknown is 0. `cells` is of no effect: pairs are not hashed
    into cells any more.
    """
    good = common.settle(labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    marked = rows.join(good.withColumn("good", F.lit(True)), "doc_id", "left").select("text", F.coalesce("good", F.lit(False)).alias("good"))
    losses = common.settle(pair_losses(common.settle(pair_counts(marked))))
    tokens = losses.agg(F.sum("corpus")).first()[0] or 0
    hot = losses.where(F.col("corpus") >= max(1, -(-tokens // HOT))).toArrow()
    before, word, target, background = (hot.column(c).to_numpy() for c in ("before", "word", "of_target", "of_background"))
    keys = common.mix(before.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + word.view(np.uint64))
    order = np.argsort(keys)
    keys, before, word, target, background = (x[order] for x in (keys, before, word, target, background))
    kinds = "row long, doc_id long, n_tokens long, target double, background double, before long, word long, times long"
    schema = pa.schema([(n, pa.float64() if k == "double" else pa.int64()) for n, k in (x.split() for x in kinds.split(", "))])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for every text with the losses of its hot pairs, and one for each other distinct pair of it."""
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            body, offsets = common.texts(batch)
            for lo, hi in common.blocks(offsets):
                prior, token, text = bigrams(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                at = np.minimum(np.searchsorted(keys, common.mix(prior.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + token.view(np.uint64))), max(0, len(keys) - 1))
                known = (before[at] == prior) & (word[at] == token) if len(keys) else np.zeros(len(token), bool)
                sums = [np.bincount(text[known], weights=x[at[known]], minlength=hi - lo) for x in (target, background)]
                ids, n = row + np.arange(hi - lo), np.bincount(text, minlength=hi - lo)
                # as these have no pair, their own number deals them out
                yield pa.RecordBatch.from_arrays([pa.array(ids), batch.column(0).slice(lo, hi - lo), pa.array(n), *map(pa.array, sums), pa.array(ids), pa.array(ids), pa.array(np.zeros(hi - lo, np.int64))], schema=schema)
                prior, token, text = prior[~known], token[~known], text[~known]
                sort, new = distinct(token, prior, text)
                own, none = sort[new], np.zeros(len(new))
                yield pa.RecordBatch.from_arrays([pa.array(ids[text[own]]), pa.nulls(len(new), pa.int64()), pa.array(none.astype(np.int64)), pa.array(none), pa.array(none),
                                                  pa.array(prior[own]), pa.array(token[own]), pa.array(np.diff(np.append(new, len(sort))))], schema=schema)
                row += hi - lo

    parts = rows.mapInArrow(split, kinds).join(losses.drop("corpus"), ["before", "word"], "left")
    total = lambda c: F.sum(F.col(c) + F.coalesce(F.col("times") * F.col(f"of_{c}"), F.lit(0.0)))
    out = parts.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_tokens").alias("n_tokens"), total("target").alias("target"), total("background").alias("background"))
    mean = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    out = out.select("doc_id", "n_tokens", F.lit(0).cast("long").alias("n_unknown"), mean("target").alias("target_loss"), mean("background").alias("background_loss"))
    return out.withColumn("score", F.col("target_loss") - F.col("background_loss"))
