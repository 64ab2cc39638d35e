"""Blocks: columns of numbers packed into binary rows, so that what is dealt out by hash costs bytes and not rows.

Documents fall into batches by a hash of their id, those without one by a hash of their text. Each batch sums up its own keys before anything is shuffled (a key that is
everywhere counts once a batch), sends them to buckets by the leading digits of the key, and gets an answer for each key it
sent, in the order it sent them. A batch is a function of its rows alone, so a recomputed task packs the same blocks, provided
that the input gives the same rows each time it is read, as tables do; write anything else (a limit without an order, a random
sample) to a table first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, small_batches

BATCH_BYTES = 8 << 20


def batched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = False, each: int = BATCH_BYTES) -> tuple[DataFrame, int]:
    """(b, id, text) with b the batch of each document; the number of batches, which grows with the bytes of text.

    Documents of a batch are packed to a few rows of compressed text, which ``in_order`` unpacks. With ``keep`` they stay rows
    of their own, and the whole input row comes along as the struct ``row``.
    """
    total = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    n = partitions(docs.sparkSession, total, each)
    rest = [F.struct(*(F.col(c) for c in docs.columns if c != text_col)).alias("row")] if keep else []
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *rest)
    d = d.select(F.pmod(F.xxhash64(F.coalesce("id", F.xxhash64("text")), F.lit("batch")), F.lit(n)).cast("int").alias("b"), *d.columns)
    if keep:
        return d, n
    small_batches(docs.sparkSession)
    return d.mapInArrow(_pack, "b int, ids binary, sizes binary, texts binary"), n


#: Stands for a null id while ids are plain numbers.
NO_ID = np.iinfo(np.int64).min
PACK_BYTES = 16 << 20


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def packed() -> Iterator[pa.RecordBatch]:
        order = np.argsort(np.array(bs), kind="stable")
        cut = np.flatnonzero(np.r_[True, np.diff(np.array(bs)[order]) != 0, True])
        out: list[list] = [[], [], [], []]
        for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
            own = order[a:z].tolist()
            data = b"".join([texts[i] for i in own])
            values = (bs[own[0]], np.array([ids[i] for i in own], np.int64).tobytes(), np.array([len(texts[i]) for i in own], np.int64).tobytes(), pa.compress(data, codec="zstd", asbytes=True) if data else b"")
            for x, v in zip(out, values, strict=True):
                x.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), *(pa.array(x, pa.binary()) for x in out[1:])], names=["b", "ids", "sizes", "texts"])

    bs: list[int] = []
    ids: list[int] = []
    texts: list[bytes] = []
    n = 0
    for batch in batches:
        bs += batch.column(0).to_pylist()
        ids += batch.column(1).fill_null(NO_ID).to_pylist()
        new = [t or b"" for t in batch.column(2).cast(pa.binary()).to_pylist()]
        texts += new
        n += sum(map(len, new))
        if n >= PACK_BYTES:
            yield from packed()
            bs, ids, texts, n = [], [], [], 0
    if bs:
        yield from packed()


def _unpack(table: pa.Table) -> pa.Table:
    ids, texts = [np.empty(0, np.int64)], []
    for i, s, t in zip(*(table.column(c).to_pylist() for c in ("ids", "sizes", "texts")), strict=True):
        ids.append(np.frombuffer(i, np.int64))
        ends = np.cumsum(np.frombuffer(s, np.int64)).tolist()
        data = pa.decompress(t, decompressed_size=ends[-1], codec="zstd", asbytes=True) if ends[-1] else b""
        texts += [data[x:y] for x, y in zip([0, *ends[:-1]], ends, strict=True)]
    every = np.concatenate(ids)
    return pa.table({"id": pa.array(every, mask=every == NO_ID), "text": pa.array(texts, pa.large_binary())})


def in_order(table: pa.Table) -> pa.Table:
    """The documents by ascending id (null first), those of equal id by text, so that the order never depends on the shuffle."""
    if "texts" in table.column_names:
        table = _unpack(table)
    if table.num_rows < 2:
        return table
    by = [("id", "ascending"), ("text", "ascending")]
    return table.take(pc.sort_indices(table.select(["id", "text"]), sort_keys=by, null_placement="at_start"))


def ids_of(table: pa.Table) -> np.ndarray:
    return table.column("id").fill_null(NO_ID).to_numpy()


def texts_of(table: pa.Table) -> list[bytes]:
    return [t or b"" for t in table.column("text").cast(pa.large_binary()).to_pylist()]


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The bucket 0..n-1 of unsigned 64-bit keys: ascending keys have ascending buckets."""
    return ((keys >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def slices(keys: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) for the buckets that ascending keys fall into."""
    if not len(keys):
        return []
    bucket = bucket_of(keys, n)
    at = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    return [(int(bucket[a]), int(a), int(b)) for a, b in zip(at[:-1], at[1:], strict=True)]


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit keys as differences of as few bytes as the largest of them needs."""
    step = np.diff(keys, prepend=np.uint64(0))
    width = max(1, (int(step[1:].max()).bit_length() + 7) // 8) if len(step) > 1 else 1
    return bytes([width]) + step[:1].tobytes() + np.ascontiguousarray(step[1:].view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    width = data[0]
    rest = np.frombuffer(data, np.uint8, offset=9).reshape(-1, width)
    step = np.zeros((len(rest) + 1, 8), np.uint8)
    step[0] = np.frombuffer(data, np.uint8, 8, 1)
    step[1:, :width] = rest
    return np.cumsum(step.reshape(-1).view(np.uint64), dtype=np.uint64)


#: What batches send to buckets and buckets answer.
ROW = "bucket int, b int, keys binary, more binary, content binary"
_FIELDS = pa.schema([("bucket", pa.int32()), ("b", pa.int32()), ("keys", pa.binary()), ("more", pa.binary()), ("content", pa.binary())])


def rows(found: list[tuple]) -> pa.Table:
    cols = list(zip(*found, strict=True)) if found else [[] for _ in _FIELDS]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _FIELDS, strict=True)], schema=_FIELDS)


def groups(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    if not len(sorted_keys[0]):
        return np.empty(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([k[1:] != k[:-1] for k in sorted_keys])])


def places(order: np.ndarray, start: np.ndarray) -> np.ndarray:
    """For each element, the number of the run it belongs to, runs beginning at ``start`` in ``order``."""
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
    return out


def answered(table: pa.Table, parts: list[tuple[int, int, int]], kind: type, n: int, field: str = "keys") -> np.ndarray:
    """The answers to ``n`` keys sent in ``parts``, in the order they were sent."""
    by = dict(zip(table.column("bucket").to_pylist(), table.column(field).to_pylist(), strict=True))
    out = np.zeros(n, kind)
    for bucket, x, y in parts:
        out[x:y] = np.frombuffer(by[bucket], kind)
    return out


def pack_counts(n: np.ndarray) -> bytes:
    """Whole numbers of 0 or more in the narrowest type that holds them all, compressed."""
    kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if not len(n) or n.max() <= np.iinfo(t).max)
    raw = n.astype(kind).tobytes()
    return bytes([np.dtype(kind).itemsize]) + len(raw).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unpack_counts(data: bytes) -> np.ndarray:
    size = int.from_bytes(data[1:9], "little")
    raw = pa.decompress(data[9:], decompressed_size=size, codec="zstd", asbytes=True) if size else b""
    return np.frombuffer(raw, f"u{data[0]}").astype(np.int64)
