"""Registered queries of the corpus operators, one per operator, over the whole of their tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from metricloom.llm.collocations import collocations
from metricloom.llm.common import each_row
from metricloom.llm.conversation_repair import damage, report
from metricloom.llm.decontaminate import contaminated
from metricloom.llm.language_id import identify, of_documents, of_pages
from metricloom.llm.lm_score import scored
from metricloom.llm.minhash import near_duplicates
from metricloom.llm.oracles import ORACLES  # noqa: F401
from metricloom.llm.packing import packed
from metricloom.llm.quality_rules import base_statistics, quality_rules
from metricloom.llm.substring_dedup import substring_dedup
from metricloom.llm.suffix_dedup import suffix_dedup
from metricloom.llm.token_counts import token_counts
from metricloom.llm.url_filter import filter_urls, with_parts, with_rules
from metricloom.llm.warc import round_trip
from metricloom.session import checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"), short=True)


def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return each_row(suffix_dedup, table(spark, folder, "documents"), "doc_id").drop("kept")


def op3_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    return scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return identify(of_documents(table(spark, folder, "documents")))


def language_of_pages(spark: SparkSession, folder: str) -> DataFrame:
    """All evidence of operator 4: pages declare a language and have an address."""
    return identify(of_pages(table(spark, folder, "pages"))).withColumnRenamed("doc_id", "page_id")


def op5_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))


def quality_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """What operator 5 goes by, without the learned verdict, which has no SQL."""
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return base_statistics(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def op6_warc(spark: SparkSession, folder: str) -> DataFrame:
    return round_trip(table(spark, folder, "pages")).drop("payload", "url")


def op7_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return each_row(near_duplicates, table(spark, folder, "documents"), "doc_id", "component_id")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return each_row(substring_dedup, table(spark, folder, "documents"), "doc_id").drop("kept_text")


def op9_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return filter_urls(table(spark, folder, "pages"))


def url_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Host, path and rule of operator 9, without the model's verdict, which has no SQL."""
    return with_rules(with_parts(table(spark, folder, "pages"))).select("page_id", "host", "path", "rule")


def tokenizer_path() -> str:
    """The word-piece vocabulary among the public tokenizers of this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"), tokenizer_path()).drop("ids")


def op11_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "conversations")
    return report(damage(rows), rows)


def piece_model_path() -> str:
    """The sentencepiece vocabulary among the public tokenizers of this machine."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """A cache of its own for each run, in the shared folder, so that every run encodes every distinct text."""
    cache = f"{checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    place = spark._jvm.org.apache.hadoop.fs.Path(cache)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    return token_counts(table(spark, folder, "documents"), piece_model_path(), cache)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_decontamination, op2_suffix_dedup, op3_lm_score, op4_language_id, language_of_pages, op5_quality_rules, quality_statistics, op6_warc, op7_minhash_dedup, op8_substring_dedup, op9_url_filter, url_rules, op10_packing, op11_collocations, op12_conversation_repair, op13_token_counts)
}
