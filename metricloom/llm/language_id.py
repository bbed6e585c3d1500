"""Language identification by Bayesian fusion of evidence.

Log evidence of each language for a row is the sum of
- the text: naive Bayes over hashed character trigrams (bytes), trained here; its mean per trigram
  times at most `WEIGHT` trigrams, as neighbouring trigrams tell much the same;
- the declared markup language and the address suffix: P(value | language), from counts of the
  value among rows whose text alone speaks for the language;
- the prior of the host: its counts of such rows, smoothed with those of its domain, which are
  smoothed with those of all rows. Counts are grouped aggregates over all rows.

A row is kept if its best language has a posterior of `SURE` or more and its text is not noise:
a third of its bytes at least are of letters, and they are likelier in some language than at random.
Every declared language with any text is learned. One that knows too little to tell its own texts
from random ones, each judged by the others it was learned from, does not speak against any text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from metricloom.llm import common

#: Trigram buckets, texts per language the trigrams are learned from, trigrams a text counts for, prior rows of a level.
BUCKETS, TRAIN, WEIGHT, PRIOR, SURE = 1 << 15, 400, 60, 20.0, 0.5
#: How much likelier than random ones a language's trigrams must be in new texts of it for the language to reject others.
SURELY = 3.0

_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])


def trigrams(body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the byte trigrams of texts end to end (A-Z folded, none across texts), and the text of each."""
    if len(body) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    fold = np.arange(256, dtype=np.uint32)
    fold[65:91] += 32
    b = fold[body]
    code = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:]) * np.uint32(0x9E3779B1)
    text = np.searchsorted(offsets, np.arange(len(code)), "right") - 1
    inside = np.arange(len(code)) + 3 <= offsets[text + 1]
    return (code >> np.uint32(32 - BUCKETS.bit_length() + 1))[inside].astype(np.int64), text[inside]


def trained(rows: DataFrame, train: int = TRAIN) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, their log probabilities by bucket, from `train` rows of each declared language, and whether they can reject.

    A language can reject if the trigrams of a text it has not seen are `SURELY` times likelier
    than random ones: each bucket is taken at what it would have without the texts it is from.

    The sample is the first of each language by a hash of ids and texts. As the rows of a language
    have been counted, only the share of hashes that holds a few times the sample is looked at,
    so what meets in one task doesn't grow with the input.
    """
    known = rows.where("declared is not null and length(text) > 0")
    sizes = {r.declared: r["count"] for r in known.groupBy("declared").count().collect()}
    languages = sorted(sizes)
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int64()), ("n", pa.int64()), ("texts", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            body, offsets = common.texts(batch)
            bucket, text = trigrams(body, offsets)
            tags = batch.column(0).to_pylist()
            for i, tag in enumerate(tags):
                total.setdefault(tag, np.zeros((2, BUCKETS), np.int64))
                own = np.bincount(bucket[slice(*np.searchsorted(text, [i, i + 1]))], minlength=BUCKETS)
                total[tag] += np.stack([own, own > 0])
        for tag, (n, texts) in total.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([tag] * len(at), pa.string()), pa.array(at), pa.array(n[at]), pa.array(texts[at])], schema=schema)

    logs, rejects = np.zeros((len(languages), BUCKETS)), np.zeros(len(languages), bool)
    picks = known.select("declared", "text", F.xxhash64("doc_id", "text").alias("order"))
    for k, tag in enumerate(languages):
        low = min(2**63 - 1, -(2**63) + 4 * train * 2**64 // sizes[tag])
        own = picks.where((F.col("declared") == tag) & (F.col("order") <= low)).orderBy("order").limit(train).select("declared", "text")
        n, texts = np.ones(BUCKETS) * 0.5, np.ones(BUCKETS)
        for r in own.mapInArrow(count, "lang string, bucket long, n long, texts long").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("texts").alias("texts")).collect():
            n[r.bucket] += r.n
            texts[r.bucket] = r.texts
        logs[k] = np.log(n / n.sum())
        seen = n - 0.5
        unseen = np.log((seen * (1 - 1 / texts) + 0.5) / n.sum())
        rejects[k] = seen.sum() > 0 and seen @ unseen / seen.sum() > math.log(SURELY / BUCKETS)
    return languages, logs, rejects


def letters_of(body: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each text are of letters."""
    return np.diff(np.concatenate([[0], np.cumsum(_LETTER[body])])[offsets])


def without_languages(rows: DataFrame) -> DataFrame:
    """(doc_id, noise) of rows, by letters alone."""
    schema = pa.schema([("doc_id", pa.int64()), ("noise", pa.bool_())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = common.texts(batch)
            size = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array((size < 3) | (3 * letters_of(body, offsets) < size))], schema=schema)

    return rows.select("doc_id", "text").mapInArrow(judge, "doc_id long, noise boolean")


def text_evidence(rows: DataFrame, languages: list[str], logs: np.ndarray, rejects: np.ndarray, weight: int = WEIGHT) -> DataFrame:
    """doc_id, declared, host, domain, suffix, n_trigrams, evidence (one per language), best (index by text alone), noise."""
    names = ["doc_id", "declared", "host", "domain", "suffix"]
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.string()) for n in names[1:]), ("n_trigrams", pa.int64()),
                        ("evidence", pa.list_(pa.float64())), ("best", pa.int32()), ("noise", pa.bool_())])
    table = logs.T.astype(np.float64).copy()
    floor = np.where(rejects, -math.log(BUCKETS), -math.inf)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = common.texts(batch)
            for lo, hi in common.blocks(offsets):
                bucket, text = trigrams(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                n = np.bincount(text, minlength=hi - lo)
                sums = np.stack([np.bincount(text, weights=table[bucket, k], minlength=hi - lo) for k in range(len(languages))], axis=1)
                mean = sums / np.maximum(n, 1)[:, None]
                letters = letters_of(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo])
                noise = (n == 0) | (mean < floor).all(1) | (3 * letters < np.diff(offsets[lo: hi + 1]))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(part.schema.get_field_index(c)) for c in names), pa.array(n.astype(np.int64)),
                     pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * len(languages)), pa.array((mean * np.minimum(n, weight)[:, None]).ravel())),
                     pa.array(mean.argmax(1).astype(np.int32)), pa.array(noise)], schema=schema)

    kinds = "doc_id long, declared string, host string, domain string, suffix string, n_trigrams long, evidence array<double>, best int, noise boolean"
    return rows.select(*names, "text").mapInArrow(score, kinds)


def _logs(values: Column) -> Column:
    return F.transform(values, lambda x: F.ln(x))


def level(scored: DataFrame, size: int, *by: str) -> DataFrame:
    """Rows of each language (by text alone) per value: a grouped aggregate, combined before it is moved."""
    own = scored.where("not noise")
    for c in by:
        own = own.where(F.col(c).isNotNull())
    return own.groupBy(*by).agg(*(F.count_if(F.col("best") == k).cast("double").alias(f"n{k}") for k in range(size)))


def identify(rows: DataFrame, train: int = TRAIN, accept: list[str] | None = None) -> DataFrame:
    """doc_id, language, posterior, text_language, noise, kept, of rows (doc_id, text, declared, host, domain, suffix).

    Defined results: a null or empty text is noise and not kept, its language the best by the other
    evidence; a null declared language, host or suffix is no evidence; without rows to learn from,
    language and posterior are null and texts with letters are kept, unless `accept` is given; a null doc_id stays null; repeated rows
    are judged each. `accept` names the languages to keep, all if None.
    """
    columns = "doc_id long, language string, posterior double, text_language string, noise boolean, kept boolean"
    languages, logs, rejects = trained(rows, train)
    if not languages:
        return without_languages(rows).select("doc_id", *(F.lit(None).cast(k).alias(c) for c, k in (x.split() for x in columns.split(", ")[1:4])), "noise",
                                              (~F.col("noise") & F.lit(accept is None)).alias("kept"))
    scored, size = common.settle(text_evidence(rows, languages, logs, rejects)), len(languages)
    counts = F.array(*(F.col(f"n{k}") for k in range(size)))
    everyone = level(scored, size).first()
    total = sum(everyone)
    base = [(n + 1.0) / (total + size) for n in everyone]
    smooth = lambda parent: F.zip_with(counts, parent, lambda n, p: (n + PRIOR * p) / (F.aggregate(counts, F.lit(0.0), lambda a, x: a + x) + PRIOR))
    constant = lambda xs: F.array(*(F.lit(float(x)) for x in xs))
    domains = common.settle(level(scored, size, "domain").select("domain", smooth(constant(base)).alias("of_domain")))
    hosts = common.settle(level(scored, size, "host", "domain").join(domains, "domain").select("host", smooth(F.col("of_domain")).alias("prior")))
    out = scored.join(hosts, "host", "left").join(domains, "domain", "left")
    evidence = [F.col("evidence"), _logs(F.coalesce("prior", "of_domain", constant(base)))]
    for name in ("declared", "suffix"):
        # P(value | language), smoothed by the value's share of all rows
        values = level(scored, size, name)
        given = F.zip_with(counts, constant(everyone), lambda n, m: (n + PRIOR * F.aggregate(counts, F.lit(0.5), lambda a, x: a + x) / F.lit(total + 1.0)) / (m + PRIOR))
        out = out.join(common.settle(values.select(name, _logs(given).alias(f"by_{name}"))), name, "left")
        evidence.append(F.coalesce(F.col(f"by_{name}"), constant([0.0] * size)))
    fused = evidence[0]
    for more in evidence[1:]:
        fused = F.zip_with(fused, more, lambda a, b: a + b)
    out = out.withColumn("fused", fused).withColumn("top", F.array_max("fused"))
    posterior = 1 / F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - F.col("top")))
    name_of = lambda at: F.get(F.array(*map(F.lit, languages)), at)
    out = out.select("doc_id", name_of(F.array_position("fused", F.col("top")).cast("int") - 1).alias("language"), posterior.alias("posterior"),
                     F.when(F.col("n_trigrams") > 0, name_of(F.col("best"))).alias("text_language"), "noise")
    fine = ~F.col("noise") & (F.col("posterior") >= SURE)
    return out.withColumn("kept", fine & F.col("language").isin(accept) if accept is not None else fine)


def of_documents(docs: DataFrame) -> DataFrame:
    """Evidence rows of documents: lang is what they declare, source the host."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("lang").alias("declared"),
                       F.col("source").alias("host"), F.regexp_replace("source", "[0-9]+$", "").alias("domain"), F.lit(None).cast("string").alias("suffix"))


def of_pages(pages: DataFrame) -> DataFrame:
    """Evidence rows of web pages: the lang attribute, the host, its last two labels, its last label; text without tags."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#:]*)", 1))
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    some = lambda c: F.when(c != "", c)
    return pages.select(F.col("page_id").cast("long").alias("doc_id"), text.alias("text"),
                        some(F.lower(F.regexp_extract(html, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?([A-Za-z]{2,3})""", 1))).alias("declared"), some(host).alias("host"),
                        some(F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)).alias("domain"), some(F.regexp_extract(host, r"\.([^.]+)$", 1)).alias("suffix"))
