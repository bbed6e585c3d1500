"""Token counts by a digest cache: each text is known by the SHA-256 of its normal form, counts are stored under it.

The cache is a table of (digest, n_tokens), one folder per tokenizer version, which is the SHA-256
of the vocabulary file with the name and version of the library that reads it. A run

1. counts the rows of each content digest and joins the distinct digests to the stored counts;
2. reads the texts once: a row whose digest is neither stored nor shared is encoded where it stands.
   Which rows these are is told by a bitmap of fixed size over the digests that are stored or
   shared: it lets no such digest through, and other rows it holds back only take the longer way;
3. joins the rows held back to the stored counts; of those not stored, one text per digest moves,
   copies merged before the exchange, and is encoded once;
4. appends the new counts to the cache. A later run reads them in step 1.

Normal form: the sentencepiece models that keep white space write a space as U+2581, so texts that
differ in that alone are one content. For other tokenizers the text is its own normal form.

Defined results: a null text is empty and has 0 bytes and 0 tokens; a null doc_id stays null; rows
that repeat a doc_id are each counted; a text of any length is encoded whole; equal texts cost one
encoding; other columns are ignored; no rows give no rows and leave the cache as it was. A digest
that was stored twice, by two runs at once, has one count all the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from metricloom.llm import common

LIMIT = 4096
_CACHE = "digest binary, n_tokens long"


def encoder(path: str) -> Callable[[list[str]], list[int]]:
    """The library's own count of each text's tokens, no token added."""
    if path.endswith(".model"):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return lambda texts: [len(ids) for ids in model.encode(texts, add_bos=False, add_eos=False, num_threads=1)]
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(path)
    whole.no_truncation()
    whole.no_padding()
    return lambda texts: [len(whole.encode(t, add_special_tokens=False).ids) for t in texts]


def version(path: str) -> str:
    """What a stored count depends on besides the text: the vocabulary file and the library."""
    import importlib.metadata

    library = "sentencepiece" if path.endswith(".model") else "tokenizers"
    with open(path, "rb") as file:
        return hashlib.sha256(f"{library} {importlib.metadata.version(library)}\n".encode() + file.read()).hexdigest()


def keeps_space(path: str) -> bool:
    """Whether a model reads U+2581 as it reads a space: no character map, no white space taken off."""
    if not path.endswith(".model"):
        return False
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    spec = model.normalizer_spec
    return spec.escape_whitespaces and not spec.remove_extra_whitespaces and not spec.precompiled_charsmap


def stored(docs: DataFrame, folder: str) -> DataFrame:
    """The stored counts, one row per digest; an absent folder is an empty cache."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], _CACHE)
    return spark.read.schema(_CACHE).parquet(folder).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def _counted(path: str, held: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Encode the rows of (text, bit, ...) whose bit is not held; give the others back with their text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(path)
        for batch in batches:
            text, bit = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            wait = np.zeros(len(bit), bool) if held is None else (held[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)
            sizes = np.where(wait, 0, pc.binary_length(text).to_numpy(zero_copy_only=False))
            tokens = np.zeros(len(bit), np.int64)
            for lo, hi in common.blocks(np.concatenate([[0], np.cumsum(sizes)])):
                at = lo + np.flatnonzero(~wait[lo:hi])
                if len(at):
                    tokens[at] = count(text.take(pa.array(at)).to_pylist())
            given = [pa.array(tokens, mask=wait), pc.if_else(pa.array(wait), text, pa.scalar(None, text.type))]
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], *given], names=[*batch.schema.names[2:], "n_tokens", "text"])

    return encode


def token_counts(docs: DataFrame, path: str, cache: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row; counts not yet in the folder `cache` are appended to it."""
    folder = f"{cache}/tokenizer={version(path)}"
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    normal = F.replace("text", F.lit("▁"), F.lit(" ")) if keeps_space(path) else F.col("text")
    rows = rows.withColumn("digest", F.unhex(F.sha2(normal, 256)))

    known = rows.groupBy("digest").count().join(stored(docs, folder), "digest", "left")
    known = common.settle(known.where("count > 1 or n_tokens is not null"))
    held = common.bit_filter(known, "digest")
    first = common.settle(rows.select("text", common.id_bit("digest").alias("bit"), "doc_id", "n_bytes", "digest").mapInArrow(
        _counted(path, held), "doc_id long, n_bytes long, digest binary, n_tokens long, text string"))

    waiting, hits = first.where("n_tokens is null"), known.where("n_tokens is not null").select("digest", "n_tokens")
    misses = waiting.select("digest", "text").join(hits, "digest", "left_anti").groupBy("digest").agg(F.any_value("text").alias("text"))
    encoded = common.settle(misses.select("text", F.lit(0).cast("long").alias("bit"), "digest").mapInArrow(
        _counted(path, None), "digest binary, n_tokens long, text string").select("digest", "n_tokens"))
    new = first.where("n_tokens is not null").select("digest", "n_tokens").unionByName(encoded)
    if not new.isEmpty():
        new.write.mode("append").parquet(folder)

    late = waiting.select("doc_id", "n_bytes", "digest").join(hits.unionByName(encoded), "digest")
    out = first.where("n_tokens is not null").select("doc_id", "n_bytes", "n_tokens").unionByName(late.select("doc_id", "n_bytes", "n_tokens"))
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
