"""Operator 13: resampling documents towards a target corpus by the importance of hashed n-grams.

Features of a text are its runs of one to three words; each falls into a bucket by its crc32. A bucket's gain tells how much more
of the target's features than of the documents' it holds; a document's weight is the sum of the gains of its features. Gumbel
noise that depends on the id alone is added, and the documents of highest score are drawn, without replacement.

The gains come from inverted postings. Documents are taken in blocks as they are read; a block sums up (bucket, document, count)
by itself and sends each range of buckets one record of its sums and one of its postings, ascending and packed. A range gets
all its records sorted, sums first: it adds up both corpora bucket by bucket, then streams the postings and gives, for each
block, the contributions of its buckets to the block's documents. These are added up by block, where the ids wait. No text is
shuffled; a posting costs about a byte.

A bucket has one posting a document at most, however often a word stands in it, and a range holds no more than one record in memory
besides its sums; blocks are bounded in bytes and in documents. Buckets bound how far the postings part: 10,000 ranges at most.
Ranks come from a range sort: places within a sorted part plus the sizes of the parts before it, a number a part on the driver.

Null and empty texts have no features, weight 0, and are not drawn where a least number of words is asked for. Null ids: the noise is that of an empty id,
ties come after all ids. Repeated rows each have their result; equal rows tie and are ranked in the order they are read. Long texts are cut into
pieces at word ends with two words carried over, so memory beyond the text itself is bounded by its buckets. Further columns are
ignored. An empty table gives an empty one; with an empty target all gains still follow the formula.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import NO_ID, pack_counts, pack_sorted, unpack_counts, unpack_sorted
from .shared import Cuts, about_bytes, partitions, small_batches

BLOCK_BYTES = 8 << 20
BLOCK_DOCS = 4096
#: Bytes of a text that are split into words at a time.
PIECE = 1 << 20
#: Kinds of records, in the order a range reads them.
TARGET, CORPUS, IDS, POSTINGS = range(4)
RECORD = pa.schema([("r", pa.int32()), ("kind", pa.int32()), ("b", pa.int64()), ("data", pa.binary()), ("more", pa.binary())])

#: Lower-cases A-Z; all other ASCII but digits and small letters parts words.
LETTERS = bytes(c if c >= 128 or 48 <= c < 58 or 97 <= c < 123 else c + 32 if 65 <= c < 91 else 32 for c in range(256))


def features(text: bytes, n_buckets: int, longest: int = 3) -> tuple[np.ndarray, int]:
    """The buckets of all features of a text, with repeats, and its number of words."""
    text = text.translate(LETTERS)
    out, carried, at, n_words = [np.empty(0, np.uint32)], [], 0, 0
    while at < len(text):
        end = text.find(b" ", at + PIECE)
        end = len(text) if end < 0 else end
        new = text[at:end].split()
        words, old = carried + new, len(carried)
        n_words += len(new)
        at = end
        hashes = list(map(crc32, words))
        out.append(np.array(hashes[old:], np.uint32))
        spaced = list(map(b" ".__add__, words[1:]))
        for n in range(2, longest + 1):
            hashes = list(map(crc32, spaced[n - 2 :], hashes))  # of runs of n words, from those of n - 1
            out.append(np.array(hashes[max(old - n + 1, 0) :], np.uint32))
        carried = words[max(len(words) - longest + 1, 0) :]
    return np.concatenate(out) % np.uint32(n_buckets), n_words


def n_features(n_words: Column, longest: int = 3) -> Column:
    return sum((F.greatest(n_words - n, F.lit(0)) for n in range(1, longest)), n_words).cast("long")


def _edges(n_buckets: int, n_ranges: int) -> list[int]:
    return [n_buckets * r // n_ranges for r in range(n_ranges + 1)]


def _records(docs: DataFrame, kind: int, n_buckets: int, n_ranges: int) -> DataFrame:
    """The records that blocks of documents (id, key, text) send to ranges of buckets."""
    edges = _edges(n_buckets, n_ranges)

    def block(b: int, ids: list, found: list[np.ndarray], sizes: list[int]) -> pa.RecordBatch:
        rows: list[tuple] = []
        of = np.repeat(np.arange(len(found)), [len(x) for x in found])
        bucket = np.concatenate(found).astype(np.int64)
        sums = np.bincount(bucket, minlength=n_buckets)
        total = len(bucket).to_bytes(8, "little")
        for r, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
            rows.append((r, kind, b, pack_counts(sums[x:y]), total))
        if kind == CORPUS:
            key, n = np.unique(bucket * len(found) + of, return_counts=True)
            cut = np.searchsorted(key, np.array(edges) * len(found)).tolist()
            for r, (x, y) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                if x < y:
                    step = pack_sorted((key[x:y] - edges[r] * len(found)).astype(np.uint64))
                    rows.append((r, POSTINGS, b, len(found).to_bytes(4, "little") + len(step).to_bytes(8, "little") + pa.compress(step, codec="zstd", asbytes=True), pack_counts(n[x:y])))
            rows.append((b % n_ranges, IDS, b, np.array(ids, np.int64).tobytes(), np.array(sizes, np.int64).tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), RECORD, strict=True)], schema=RECORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b = TaskContext.get().partitionId() << 32
        ids, found, sizes, n_bytes = [], [], [], 0
        for batch in batches:
            for i, k, t in zip(batch.column(0).fill_null(NO_ID).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary())):
                text = t.as_py() or b""
                buckets, n_words = features(text, n_buckets)
                ids.append((i, k))
                found.append(buckets.astype(np.uint16) if n_buckets <= 1 << 16 else buckets)
                sizes.append(n_words)
                n_bytes += len(text)
                if n_bytes >= BLOCK_BYTES or len(ids) >= BLOCK_DOCS:
                    yield block(b, ids, found, sizes)
                    b, ids, found, sizes, n_bytes = b + 1, [], [], [], 0
        if ids:
            yield block(b, ids, found, sizes)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, "r int, kind int, b long, data binary, more binary")


def gains(s: np.ndarray, t: np.ndarray, s_all: int, t_all: int, n_buckets: int) -> np.ndarray:
    """floor(1000 ln) of the target's smoothed share of each bucket over the documents'."""
    found = ((float(y + 1) * float(s_all + n_buckets)) / (float(x + 1) * float(t_all + n_buckets)) for x, y in zip(s.tolist(), t.tolist(), strict=True))
    return np.array([math.floor(1000 * math.log(x)) for x in found], np.int64)


def _weigh(n_buckets: int, n_ranges: int):
    """From a range's records, sorted by kind, to contributions: what its buckets add to the documents of each block."""
    edges = _edges(n_buckets, n_ranges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, gain, both, totals = -1, None, {}, {}
        for batch in batches:
            out: list[tuple] = []
            for r, kind, b, data, more in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if r != at:
                    at, gain = r, None
                    both, totals = {k: np.zeros(edges[r + 1] - edges[r], np.int64) for k in (TARGET, CORPUS)}, {TARGET: 0, CORPUS: 0}
                if kind == IDS:
                    out.append((b, IDS, data, more))
                elif kind != POSTINGS:
                    both[kind] += unpack_counts(data)
                    totals[kind] += int.from_bytes(more, "little")
                else:
                    if gain is None:
                        gain = gains(both[CORPUS], both[TARGET], totals[CORPUS], totals[TARGET], n_buckets)
                    n_docs = int.from_bytes(data[:4], "little")
                    key = unpack_sorted(pa.decompress(data[12:], decompressed_size=int.from_bytes(data[4:12], "little"), codec="zstd", asbytes=True)).astype(np.int64)
                    bucket, doc = np.divmod(key, n_docs)
                    added = np.bincount(doc, weights=gain[bucket] * unpack_counts(more), minlength=n_docs).astype(np.int64)  # whole numbers below 2**53
                    out.append((b, POSTINGS, pa.compress(added.tobytes(), codec="zstd", asbytes=True), None))
            names, kinds = ["b", "kind", "data", "more"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 4, kinds, strict=True)], names=names)

    return run


def _add_up(table: pa.Table) -> pa.Table:
    """The documents of a block with the sums of their contributions."""
    ids, words, weight = None, None, 0
    for b, kind, data, more in zip(*(c.to_pylist() for c in table.columns), strict=True):
        if kind == IDS:
            ids, words = np.frombuffer(data, np.int64).reshape(-1, 2), np.frombuffer(more, np.int64)
    for kind, data in zip(table.column("kind").to_pylist(), table.column("data").to_pylist(), strict=True):
        if kind == POSTINGS:
            weight = weight + np.frombuffer(pa.decompress(data, decompressed_size=8 * len(ids), codec="zstd", asbytes=True), np.int64)
    weight = np.zeros(len(ids), np.int64) + weight
    own = np.ascontiguousarray(ids[:, 0])
    b = np.full(len(ids), table.column("b")[0].as_py())
    columns = [pa.array(own, mask=own == NO_ID), pa.array(ids[:, 1].copy()), pa.array(words), pa.array(weight), pa.array(b), pa.array(np.arange(len(ids)), pa.int32())]
    return pa.Table.from_arrays(columns, names=["id", "key", "n_words", "weight", "b", "place"])


def row_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n_buckets: int = 10_000) -> DataFrame:
    """(id, key, n_words, weight, b, place) of each document; b and place tell rows apart."""
    spark = docs.sparkSession
    n = min(partitions(spark, about_bytes(docs, text_col), 32 << 20), n_buckets)
    n_ranges = min(4 * n, n_buckets)
    d = docs.select(F.col(id_col).cast("long").alias("id"), row_key(id_col, text_col).alias("key"), F.col(text_col).alias("text"))
    t = target.select(F.lit(0).cast("long").alias("id"), F.lit(0).cast("long").alias("key"), F.col(target_col).alias("text"))
    records = _records(d, CORPUS, n_buckets, n_ranges).unionByName(_records(t, TARGET, n_buckets, n_ranges))
    records = records.repartition(n, "r").sortWithinPartitions("r", "kind", "b")
    found = records.mapInArrow(_weigh(n_buckets, n_ranges), "b long, kind int, data binary, more binary")
    return found.groupBy("b").applyInArrow(_add_up, "id long, key long, n_words long, weight long, b long, place int")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", n_buckets: int = 10_000, percent: int = 5, min_words: int = 20, seed: int = 42
) -> DataFrame:
    """(id_col, n_features, weight, score, rank, key) of each document; rank is null for those not drawn. ``drawn`` gives whole rows."""
    spark = docs.sparkSession
    cuts = Cuts(spark, "importance")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = cuts.cut(weigh(docs, target, id_col, text_col, target_col, n_buckets).withColumn("score", F.col("weight") + noise))
    # sorted parts: the place in a part is in the lower 33 bits, the number of the part above them
    order = [(F.col("n_words") < min_words).asc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("b"), F.col("place")]
    n = partitions(spark, about_bytes(scored, "id"))
    ordered = cuts.cut(scored.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    cuts.drop(scored)
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.cast("int").alias("part")).agg(F.count("*").alias("n"), F.count_if(F.col("n_words") >= min_words).alias("eligible")).collect()
    before, sums = [], 0
    for r in sorted(sizes, key=lambda r: r["part"]):
        before.append((r["part"], sums))
        sums += r["n"]
    n_drawn = percent * sum(r["eligible"] for r in sizes) // 100
    before = spark.createDataFrame([x for x in before if x[1] < n_drawn], "part int, before long")
    placed = ordered.withColumn("part", part.cast("int")).join(before, "part", "left")
    rank = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.select(F.col("id").alias(id_col), n_features(F.col("n_words")).alias("n_features"), "weight", "score", F.when(rank <= n_drawn, rank).alias("rank"), "key")


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The drawn rows of ``docs``, whole; of rows that are equal in id and text, all if one is drawn."""
    keys = resample(docs, target, id_col, text_col, **how).where("rank is not null").select(F.col("key").alias("_drawn")).distinct()
    return docs.join(keys, row_key(id_col, text_col) == F.col("_drawn"), "left_semi")
