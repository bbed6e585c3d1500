"""Near-duplicates by circulant MinHash, banding, and exact Jaccard verification.

1. `signatures`: a document's set of word shingles; one bijection (sigma) scatters it, a second
   one (pi), shifted by k, gives coordinate k of the signature as the least value over the set.
   32 bands of 4 coordinates become band keys: at a similarity of 0.75 two documents share one
   with a probability of 1 - 5e-6, above that more.
2. Documents with equal sets are one class from here on, named by its smallest id.
3. In each bucket (documents that share a band key) one document is the leader: the one that
   shares most buckets with others, as the original of a group of copies does. Every member is
   compared with its leaders only, on full sets. A bucket of n gives n pairs, not n^2.
4. A pair that is not compared directly shares a leader b. `added` are the shingles that x has and
   b has not, `gone` those b has and x has not. The difference of x and y follows from what they
   share of these, and they are linked just if 7 times it is at most |x| + |y|. For documents in
   different components (so not both linked to b) that needs some shared elements, in most cases
   some of the rare `added` ones, in number at least 1/14 of
   7 (added(x) + added(y) + |gone(x) - gone(y)|) - |x| - |y|. So only documents with enough rare
   elements in common are paired (a positional prefix filter), and the shared elements decide
   exactly. No link between documents that share a bucket is lost.
5. Components of all links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from metricloom.llm import common
from metricloom.llm.components import components

SHINGLE, BANDS, ROWS = 5, 32, 4
_SIGMA = 0x8CB92BA72F3D8DD7
_PI = np.array([0x7FEB352D, 0x846CA68B], np.uint32)


def shingle_sets(body: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text of a block, sorted, and where each text's begin.

    A text with fewer words than `size`, but one at least, has its whole sequence as one shingle.
    """
    _, _, hashes, first = common.words(body, offsets, fold=True)
    grams, out, ends = common.gram_hash(hashes, size), [], [0]
    for lo, hi in zip(first[:-1], first[1:], strict=True):
        if hi - lo >= size:
            own = np.unique(grams[lo: hi - size + 1])
        elif hi > lo:
            own = common.mix(common.gram_hash(hashes[lo:hi], hi - lo), hi - lo)
        else:
            own = grams[:0]
        out.append(own)
        ends.append(ends[-1] + len(own))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.array(ends)


def _pi(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit integers, in place."""
    x ^= x >> np.uint32(16)
    x *= _PI[0]
    x ^= x >> np.uint32(15)
    x *= _PI[1]
    return x


def circulant(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Signature of one set: coordinate k is the least pi(sigma(x) + k), with + modulo 2^32."""
    scattered = (common.mix(shingles, _SIGMA) >> np.uint64(32)).astype(np.uint32)
    shift = np.arange(coordinates, dtype=np.uint32)[:, None]
    least = np.full(coordinates, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(scattered), 512):
        np.minimum(least, _pi(scattered[None, at: at + 512] + shift).min(axis=1), out=least)
    return least


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n, s1, s2, keys) of `keyed` documents: set size, set digest, band keys."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("keys", pa.list_(pa.int64()))])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = common.texts(batch)
            ids = batch.column(0)
            for lo, hi in common.blocks(offsets):
                sets, first = shingle_sets(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], size)
                n = np.diff(first)
                digest = [np.zeros(hi - lo, np.uint64) for _ in range(2)]
                keys = np.zeros((hi - lo, bands), np.uint64)
                for i in np.flatnonzero(n):
                    own = sets[first[i]: first[i + 1]]
                    for d, salt in zip(digest, (1, 2), strict=True):
                        d[i] = common.mix(own, salt).sum(dtype=np.uint64)
                    grid = circulant(own, bands * rows).reshape(bands, rows).astype(np.uint64)
                    key = np.arange(bands, dtype=np.uint64)
                    for r in range(rows):
                        key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, r])
                    keys[i] = key
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), pa.array(n.astype(np.int64)), *(pa.array(d.view(np.int64)) for d in digest),
                     pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32) * bands), pa.array(keys.ravel().view(np.int64)))],
                    schema=schema)

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n long, s1 long, s2 long, keys array<long>")


def sets_of(docs: DataFrame, ids: DataFrame, name: str, size: int) -> DataFrame:
    """(doc_id, shingles) of at least the documents with these ids, read past a filter of fixed size."""
    bits = common.bit_filter(ids, name)
    schema = pa.schema([("doc_id", pa.int64()), ("shingles", pa.list_(pa.int64()))])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 > 0))
            body, offsets = common.texts(batch)
            for lo, hi in common.blocks(offsets):
                sets, first = shingle_sets(body[offsets[lo]: offsets[hi]], offsets[lo: hi + 1] - offsets[lo], size)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.ListArray.from_arrays(
                    pa.array(first.astype(np.int32)), pa.array(sets.view(np.int64)))], schema=schema)

    return docs.select("doc_id", "text", common.id_bit("doc_id").alias("bit")).mapInArrow(extract, "doc_id long, shingles array<long>")


def compared(docs: DataFrame, buckets: DataFrame, size: int) -> DataFrame:
    """Every (leader b, member x) of the buckets (key, x, members), compared on full sets.

    Returns b, x, nb, nx, linked, and what sets them apart: `gone` (only in b) and `added` (only in x).
    """
    reach = buckets.groupBy("x").agg(F.sum("members").alias("reach"))
    ranked = buckets.join(reach, "x").select("key", F.struct("reach", (-F.col("x")).alias("low"), "x").alias("rank"))
    leader = ranked.groupBy("key").agg(F.max("rank").alias("rank")).select("key", F.col("rank.x").alias("b"))
    pairs = common.settle(buckets.join(leader, "key").where("x != b").select("b", "x").distinct())
    left = sets_of(docs, pairs, "b", size).select(F.col("doc_id").alias("b"), F.col("shingles").alias("of_b"))
    right = sets_of(docs, pairs, "x", size).select(F.col("doc_id").alias("x"), F.col("shingles").alias("of_x"))
    both = pairs.join(left, "b").join(right, "x").withColumns({
        "nb": F.size("of_b").cast("long"), "nx": F.size("of_x").cast("long"),
        "gone": F.array_except("of_b", "of_x"), "added": F.array_except("of_x", "of_b")})
    return both.select("b", "x", "nb", "nx", (7 * (F.size("gone") + F.size("added")) <= F.col("nb") + F.col("nx")).alias("linked"), "gone", "added")


def indirect(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Links (u, v) between members of one leader that are in different components so far."""
    open_leaders = pairs.where("not linked").select("b").distinct()
    own = (pairs.join(open_leaders, "b").join(members.withColumnRenamed("node", "x"), "x", "left")
           .withColumns({"component": F.coalesce("component", "x"), "g": F.size("gone").cast("long"), "d": F.size("added").cast("long")}))
    tokens = own.select("b", "x", "component", F.explode("gone").alias("t")).union(own.select("b", "x", "component", F.explode("added").alias("t")))
    shared = tokens.groupBy("b", "t").agg(F.count("*").alias("df"), F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    kept = (tokens.join(shared.select("b", "t", "df"), ["b", "t"]).groupBy("b", "x")
            .agg(F.expr("array_sort(collect_list(struct(df, t))).t").alias("both")))
    # elements that no document of another component has cannot be shared: they are left out from here on
    kept = common.settle(own.join(kept, ["b", "x"]).withColumns({
        "gone": F.array_intersect("both", "gone"), "added": F.array_intersect("both", "added"),
        "grade": F.expr("int(floor(16D * nx / nb))")}))
    facts = ["b", "x", "component", "nx", "g", "d"]
    far = lambda df: df.select("b", "t", *(F.col(c).alias(f"{c}_y") for c in [*facts[1:], *(c for c in df.columns if c in ("rest", "grade"))]))
    # 14 times the number of added elements that x and y must share to be linked
    need = "7 * (d + d_y + abs(g - g_y)) - nx - nx_y"

    added = kept.select(*facts, F.posexplode("added").alias("i", "t"), F.size("added").alias("n")).withColumn("rest", F.expr("n - i")).drop("i", "n")
    some = added.join(far(added), ["b", "t"]).where(f"x < x_y and component != component_y and {need} between 1 and 14 * least(rest, rest_y)")
    # y so much shorter that no added element need be shared; then one that sets both apart from b is. At least one of x, y
    # is not linked to b: of that one, the elements go to the sizes (sixteenths of b) in which such y can be
    apart = F.ceil((7 * (F.col("g") + F.col("d")) - F.col("nx") - F.col("nb")) / 14)
    short = kept.where("not linked").withColumns({
        "low": F.expr("int(floor(12D * nx / nb))"),
        "high": F.expr("int(floor(16D * (nb - (7 * d + 4 * (nb - nx) - nb) / 3) / nb))"),
        "first": F.slice("both", F.lit(1), F.greatest(F.lit(0), F.size("both") - apart + 1).cast("int"))})
    short = (short.withColumn("high", F.least("high", F.expr("int(ceil(64D * nx / nb / 3))"))).where("high >= low")
             .select(*facts, F.explode(F.sequence("low", "high")).alias("grade"), "first").select(*facts, "grade", F.explode("first").alias("t")))
    sized = kept.select(*facts, "grade", F.explode("both").alias("t"))
    other = far(sized).withColumnRenamed("grade_y", "grade")
    rest = short.join(other, ["b", "grade", "t"]).where(f"component != component_y and {need} <= 0")
    found = some.select("b", "x", "x_y").union(rest.select("b", "x", "x_y")).distinct()
    side = kept.select("b", F.col("x").alias("x_y"), F.col("nx").alias("nx_y"), F.col("g").alias("g_y"), F.col("d").alias("d_y"), F.col("both").alias("both_y"))
    exact = found.join(kept.select("b", "x", "nx", "g", "d", "both"), ["b", "x"]).join(side, ["b", "x_y"])
    difference = F.col("g") + F.col("d") + F.col("g_y") + F.col("d_y") - 2 * F.size(F.array_intersect("both", "both_y"))
    return exact.where(7 * difference <= F.col("nx") + F.col("nx_y")).select(F.col("x").alias("u"), F.col("x_y").alias("v")).distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document; links have 100 |a&b| >= 75 |a|b|.

    Defined results: a document without words has an empty set, no link and is kept; a null text
    is empty; a null doc_id counts as the smallest and comes back as null; rows that repeat a
    doc_id are one document with the largest of their texts; other columns are ignored.
    """
    docs = common.keyed(docs)
    signed = common.settle(signatures(docs, size, bands, rows))
    # written, so that the last join meets it by an exchange and can split a class with very many copies
    classes = common.settle(signed.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("x"), F.first("keys").alias("keys")))
    banded = classes.select("x", F.explode("keys").alias("key"))
    full = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    buckets = common.settle(banded.join(full, "key"))
    pairs = common.settle(compared(docs, buckets, size))
    direct = pairs.where("linked").select(F.col("b").alias("u"), F.col("x").alias("v"))
    star = common.settle(components(direct))
    more = common.settle(indirect(pairs, star))
    linked = components(star.select(F.col("node").alias("u"), F.col("component").alias("v")).union(more)) if not more.isEmpty() else star
    out = (signed.join(classes.select("s1", "s2", "n", "x"), ["s1", "s2", "n"], "left")
           .join(linked.withColumnRenamed("node", "x"), "x", "left")
           .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "x", "doc_id").alias("component_id")))
    return common.unkeyed(out.withColumn("kept", F.expr("doc_id = component_id")), "doc_id", "component_id")
