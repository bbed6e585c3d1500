"""A corpus pipeline of five stages over the documents table, each on all that its predecessor kept.

Rows that share a doc_id, or have none, are documents of their own in every stage. A null text is
empty, texts of any length are read whole, nulls in other columns change nothing, and columns
besides those of documents are left out; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricloom.llm import common, decontaminate, language_id, minhash, packing, suffix_dedup
from metricloom.llm.queries import table, tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Words a worker of the packing stage remembers; what it takes up stays with the worker, which goes on to other work.
KNOWN_WORDS = 100_000


def _small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of at most 1000 rows: a batch of 10,000 long texts takes hundreds of MB twice."""
    name, most = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
    if not 0 < int(spark.conf.get(name)) <= most:
        spark.conf.set(name, most)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The `rowed` documents whose id is not among those that go, with their own ids; a null id is compared like any other.

    The ids are written first, so that the join is planned by their size and texts move only if they are many.
    """
    gone = common.settle(gone.select(F.col("doc_id").alias("_gone")).distinct())
    return docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gone")), "left_anti").withColumn("doc_id", F.col("_doc")).select(*COLUMNS)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents of no language: texts without letters and texts more like noise than like any language."""
    _small_batches(spark)
    docs, _ = common.rowed(docs.select(*COLUMNS))
    found = language_id.identify(language_id.of_documents(docs))
    return _without(docs, found.where("not kept"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each group of near-duplicates."""
    _small_batches(spark)
    docs, _ = common.rowed(docs.select(*COLUMNS))
    found = minhash.near_duplicates(docs)
    return _without(docs, found.where("not kept"))


def drop_repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut strings of 100 bytes or more that stand earlier in the corpus out of the texts.

    The bytes of characters that a cut leaves incomplete go as well. All documents stay, some empty.
    """
    _small_batches(spark)
    docs, _ = common.rowed(docs.select(*COLUMNS))
    kept = suffix_dedup.suffix_dedup(docs, text=True).select(F.col("doc_id").alias("_row"), F.col("kept").alias("text"))
    rest = docs.select("doc_id", "_doc", "lang", "source")
    rest = rest.join(kept, F.col("doc_id").eqNullSafe(F.col("_row"))).withColumn("doc_id", F.col("_doc"))
    return rest.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that leak a benchmark item."""
    _small_batches(spark)
    docs, _ = common.rowed(docs.select(*COLUMNS))
    return _without(docs, decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark"), short=True))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the texts into sequences of 2048 tokens: one row per piece, as operator 10 gives them."""
    _small_batches(spark)
    return packing.packed(docs, tokenizer_path(), known=KNOWN_WORDS).drop("ids")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeated_strings", drop_repeated_strings),
    ("contamination", drop_contaminated),
    ("packing", pack),
]

#: Band keys, trigrams and token ids are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over documents; each result is written and read back as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = common.settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
