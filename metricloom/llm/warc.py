"""WARC archives: writing with revisit records and segments, reading back with reassembly.

Archives are text files of Spark's own writer whose line end is the CRLF CRLF that closes a WARC
record, so they can be in any store Spark writes to; every row is one whole record in raw bytes.
A payload longer than a segment is cut into a first record and continuation records. HTTP
payloads go out in chunked framing.

Reading: files are of bounded size (`RECORDS` records each) and are parsed one by one; records are
taken by their Content-Length. Continuations are grouped with their origin by its record id,
ordered by segment number, checked against the total length the last one declares, and joined;
only segmented records move. Chunked framing is decoded after that.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from metricloom.llm import common
from metricloom.session import checkpoint_dir

LEAST = 1000  # bytes from which equal payloads are written once
SEGMENT = 1 << 20
CHUNK = 1 << 14
RECORDS = 2000
EOL = b"\r\n"
_IDS = "urn:page:"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """HTTP/1.1 chunked framing."""
    parts = [b"%x\r\n%s\r\n" % (len(payload[i: i + size]), payload[i: i + size]) for i in range(0, len(payload), size)]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; extensions and trailers are passed over, a broken frame is an error."""
    out, at = [], 0
    while True:
        end = body.index(EOL, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if not size:
            return b"".join(out)
        if len(body) < at + size + 2 or body[at + size: at + size + 2] != EOL:
            raise ValueError("broken chunk")
        out.append(body[at: at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + EOL + block


def _clean(url: str | None) -> str | None:
    """A header value: line breaks would end it."""
    return None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")


def records_of(key: str, url: str | None, payload: bytes, digest: str, refers: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of one page: a response and its continuations, or a revisit of the page `refers`."""
    fields = [("WARC-Record-ID", f"<{_IDS}{key}>"), ("WARC-Target-URI", _clean(url)), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if refers is not None:
        http = b"HTTP/1.1 200 OK\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [_record([("WARC-Type", "revisit"), *fields, ("WARC-Refers-To", f"<{_IDS}{refers}>")], http)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i: i + segment] for i in range(0, len(block), segment)]
    if len(parts) == 1:
        return [_record([("WARC-Type", "response"), *fields], block)]
    out = [_record([("WARC-Type", "response"), *fields, ("WARC-Segment-Number", 1)], parts[0])]
    for n, part in enumerate(parts[1:], 2):
        total = len(block) if n == len(parts) else None
        out.append(_record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{_IDS}{key}/{n}>"), ("WARC-Segment-Origin-ID", f"<{_IDS}{key}>"),
                            ("WARC-Segment-Number", n), ("WARC-Segment-Total-Length", total)], part))
    return out


def write_archives(pages: DataFrame, path: str, least: int = LEAST, segment: int = SEGMENT) -> None:
    """Write one record per page (page_id, url, html); of equal payloads of `least` bytes or more the largest page_id is the response.

    The group of a payload is named by its SHA-1 and length. Only the largest id per group is
    aggregated, before it is moved; pages meet it in a join that splits a group of many copies.
    A null html is an empty payload, a null url gives no target. Of rows that share a page_id or
    have none, and a payload too, one is the response and the others revisit it.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    # a name of the record within these archives: page_id, and the row for ids that repeat or are null
    name = F.concat_ws(":", F.monotonically_increasing_id().cast("string"), F.col("page_id").cast("string"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.length("payload"), "name": name})
    groups = (rows.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max(F.struct("page_id", "name")).alias("top"), F.count("*").alias("n"))
              .where("n > 1").select("digest", "size", F.col("top.name").alias("response")))
    rows = rows.join(common.settle(groups), ["digest", "size"], "left").withColumn("refers", F.expr("if(response = name, null, response)"))

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = [r for row in part.to_pylist() for r in records_of(row["name"], row["url"], row["payload"], row["digest"], row["refers"], segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    written = rows.select("name", "url", "payload", "digest", "refers").mapInArrow(render, "value binary")
    # a cast of binary to string keeps the bytes as they are
    (written.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", "gzip")
     .option("maxRecordsPerFile", RECORDS).text(path))


def parsed(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of the records of an archive."""
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        lines = content[at:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
        start, size = end + 4, int(fields["content-length"])
        if content[start + size: start + size + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield fields, content[start: start + size]
        at = start + size + 4


def _page(name: str | None) -> int | None:
    """The page_id in a record's name."""
    page = (name or "").removeprefix(_IDS).partition(":")[2]
    return int(page) if page else None


RECORD = "record_id string, record_type string, url string, digest string, refers_to string, origin string, segment int, total long, block binary"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """All records (RECORD) of the archives in a folder, segments as they are."""
    names = ("warc-record-id", "warc-type", "warc-target-uri", "warc-payload-digest", "warc-refers-to", "warc-segment-origin-id")
    schema = pa.schema([(n.split()[0], {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[n.split()[1]]) for n in RECORD.split(", ")])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw, out, held = content.as_buffer().to_pybytes(), [], 0
                for f, block in parsed(zlib.decompress(raw, 47) if raw[:2] == b"\x1f\x8b" else raw):
                    values = [f[n].removeprefix("<").removesuffix(">") if n in f else None for n in names]
                    number, total = f.get("warc-segment-number"), f.get("warc-segment-total-length")
                    out.append((*values, int(number) if number else None, int(total) if total else None, block))
                    held += len(block)
                    if held > common.BLOCK:
                        yield common.batch_of(out, schema)
                        out, held = [], 0
                yield common.batch_of(out, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").mapInArrow(parse, RECORD)


def reassembled(records: DataFrame) -> DataFrame:
    """Whole records: continuations are put back behind their origin; a gap or a wrong total length is an error."""
    whole = records.where("segment is null")
    parts = records.where("segment is not null").withColumn("of", F.coalesce("origin", "record_id"))
    # the pieces of one record, which is held whole anyhow
    joined = (parts.groupBy("of").agg(F.array_sort(F.collect_list(F.struct("segment", "block"))).alias("p"), F.max("total").alias("total"),
                                      *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "url", "digest", "refers_to")))
              .withColumn("block", F.expr("aggregate(p.block, cast('' as binary), (a, x) -> a || x)")))
    sound = F.expr("p[size(p) - 1].segment = size(p) and p[0].segment = 1 and length(block) = total")
    joined = joined.withColumn("block", F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments are missing of "), F.col("of")))))
    columns = ["record_id", "record_type", "url", "digest", "refers_to", "block"]
    return whole.select(*columns).unionByName(joined.withColumn("record_id", F.col("of")).select(*columns))


def payloads(records: DataFrame) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to of whole HTTP records.

    A revisit has no payload of its own (null); its length and digest are those it declares.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                out = []
                for r in batch.slice(at, 64).to_pylist():
                    head, _, body = r["block"].partition(b"\r\n\r\n")
                    http = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode().split("\r\n")[1:])}
                    declared = r["digest"].removeprefix("sha1:")
                    key, refers = (_page(v) for v in (r["record_id"], r["refers_to"]))
                    if r["record_type"] == "revisit":
                        out.append((key, r["url"], None, int(http["content-length"]), declared, "revisit", refers))
                        continue
                    payload = dechunked(body) if http.get("transfer-encoding") == "chunked" else body
                    if (digest := hashlib.sha1(payload).hexdigest()) != declared:
                        raise ValueError(f"the payload of {key} doesn't have its digest")
                    out.append((key, r["url"], payload, len(payload), digest, r["record_type"], None))
                yield common.batch_of(out, schema)

    return records.select("record_id", "record_type", "url", "digest", "refers_to", "block").mapInArrow(
        decode, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Write the pages as archives in a new folder of the shared checkpoint folder and read them back."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, segment=segment)
    return payloads(reassembled(read_records(spark, path)))
