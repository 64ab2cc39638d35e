"""Operator 8: suffix-array deduplication, with suffixes sorted through the threshold only.

A byte goes when it lies in a ``span``-byte string that also starts in a document with a smaller id. Strings are judged on the
input; matches never cross documents; nulls count as empty; texts shorter than ``span`` bytes lose nothing; of rows with equal
ids none counts as smaller, and a row without an id counts as smaller than all with one. Ids are whole numbers. A text of any
length belongs to one batch, whose task holds some thirty times its bytes. An empty table gives an empty result.

Three rounds over batches of documents (see ``blocks``):

1. Each window of ``span`` bytes has an anchor, the lowest-hashed k-gram in it, so equal windows have equal anchors. Anchors
   are dealt out by the leading digits of their hash, the first digit of the radix sort; only anchors met in two documents go
   on. This round works with hashes and may keep too much, never too little.
2. For each anchor kept, the bytes of the windows around it are sent to the bucket of that anchor. There the suffixes that
   start at the windows are sorted by most significant digits, eight bytes a pass, dropping suffixes that stand alone, down to
   ``span`` bytes and no further: equal groups are the repeated windows, compared byte by byte. Each gets its smallest id.
3. Each batch learns the smallest id of every window it sent and marks the bytes under those that a smaller id has.

An anchor seen very often (a passage that a third of the documents share) has as many surroundings; its windows are sent one
by one to buckets by their own bytes, so that equal ones collapse within a batch and different ones part.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import NO_ID, ROW, batched, ids_of, in_order, pack_sorted, rows, slices, texts_of, unpack_sorted

SPAN = 50
#: Length of an anchor. A longer one is seldom repeated by chance, a shorter one leaves fewer anchors.
GRAM = 28
#: Occurrences of an anchor beyond which its windows travel one by one.
HOT = 4096
SEGMENT = 1 << 19
#: Bytes of text of a batch.
BATCH = 6 << 20
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_C = np.uint64(0x9E3779B97F4A7C15)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_C), n, 1 << 64))


def _mix(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> np.uint64(32))
    z *= np.uint64(0xD6E8FEB86659FD93)
    z ^= z >> np.uint64(29)
    z *= np.uint64(0xC2B2AE3D27D4EB4F)
    return z ^ (z >> np.uint64(32))


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on, built from those of halves."""
    h, length, out, done = _BYTE[data], 1, None, 0
    while True:
        if size & length:
            if out is None:
                out, done = h, length
            else:  # the part so far follows this one
                n = len(data) - done - length + 1
                out = h[:n] * _power(done) + out[length : length + n]
                done += length
        if length * 2 > size:
            return _mix(out)
        h = h[:-length] * _power(length) + h[length:]
        length *= 2


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    length = 1
    while length * 2 <= width:
        v = np.minimum(v[:-length], v[length:])
        length *= 2
    return np.minimum(v[: len(v) - (width - length)], v[width - length :]) if width > length else v


def runs(texts: list[bytes], span: int, gram: int) -> tuple[np.ndarray, ...]:
    """All windows of ``texts``, in runs that share an anchor: the joined bytes, and by run first window, windows, anchor, key, text."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes)
    found: list[tuple[np.ndarray, ...]] = []
    low = np.uint64((1 << 20) - 1)
    for at in range(0, max(0, len(data) - span + 1), SEGMENT):
        part = data[at : at + SEGMENT + span - 1]
        h = gram_hashes(part, gram)
        m = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), span - gram + 1) & low  # the anchor of each window
        n = len(m)
        text = np.searchsorted(ends, at, "right")
        inside = np.empty(n, np.int32)  # bytes left in the text from each window on, cut off at n + span
        place = 0
        while place < n:
            to = min(n, int(ends[text]) - at)
            inside[place:to] = np.minimum(int(ends[text]) - at - np.arange(place, to), SEGMENT + span)
            place, text = max(to, place), text + 1
        whole = inside >= span
        cut = np.flatnonzero(np.r_[True, (m[1:] != m[:-1]) | (whole[1:] != whole[:-1])])
        length = np.diff(np.append(cut, n))
        keep = whole[cut]
        cut, length = cut[keep], length[keep]
        anchor = m[cut].astype(np.int64)
        found.append((cut + at, length, anchor + at, h[anchor]))
    if not found:
        empty = np.empty(0, np.int64)
        return data, empty, empty, empty, empty.astype(np.uint64), empty
    first, length, anchor, key = (np.concatenate(x) for x in zip(*found, strict=True))
    return data, first, length, anchor, key, np.searchsorted(ends, first, "right")


def _unique_keys(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending distinct keys, how often each occurs (1 also for any number within one text), and each run's place among them."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.empty(0, np.int64)
    count = np.diff(np.append(start, len(k)))
    if len(k):
        t = text[order]
        count = np.where(np.minimum.reduceat(t, start) == np.maximum.reduceat(t, start), 1, count)
    place = np.empty(len(k), np.int64)
    place[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(k))))
    return k[start], count, place


def _send_keys(n: int, span: int, gram: int):
    def send(table: pa.Table) -> pa.Table:
        texts = texts_of(in_order(table))
        keys, count, _ = _unique_keys(*(lambda r: (r[4], r[5]))(runs(texts, span, gram)))
        b = table.column("b")[0].as_py()
        return rows([(bucket, b, pack_sorted(keys[x:y]), np.minimum(count[x:y], 65535).astype(np.uint16).tobytes(), None) for bucket, x, y in slices(keys, n)])

    return send


def _answer_keys(hot: int):
    """By key sent: bit 0 if two documents have it, bit 1 if it is hot."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("b")
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        sizes = np.array([len(k) for k in keys])
        k = np.concatenate(keys)
        count = np.concatenate([np.frombuffer(x, np.uint16) for x in table.column("more").to_pylist()]).astype(np.int64)
        order = np.argsort(k, kind="stable")
        s = k[order]
        start = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
        total = np.add.reduceat(count[order], start)
        flag = np.empty(len(k), np.uint8)
        flag[order] = np.repeat((total > 1).astype(np.uint8) + 2 * (total > hot).astype(np.uint8), np.diff(np.append(start, len(s))))
        at = np.cumsum(sizes) - sizes
        return rows([(bucket, b, flag[x : x + y].tobytes(), None, None) for bucket, b, x, y in zip(table.column("bucket").to_pylist(), table.column("b").to_pylist(), at.tolist(), sizes.tolist(), strict=True)])

    return answer


class _Sent:
    """What a batch sends in the second round, and whose windows it is; the same each time it is made."""

    def __init__(self, docs: pa.Table, flags: pa.Table, n: int, span: int, gram: int):
        docs = in_order(docs)
        self.ids, texts = ids_of(docs), texts_of(docs)
        self.data, first, length, anchor, key, text = runs(texts, span, gram)
        self.texts = texts
        keys, _, place = _unique_keys(key, text)
        flag = np.zeros(len(keys), np.uint8)
        by = dict(zip(flags.column("bucket").to_pylist(), flags.column("keys").to_pylist(), strict=True))
        for bucket, x, y in slices(keys, n):
            flag[x:y] = np.frombuffer(by[bucket], np.uint8)
        mine = flag[place]
        plain, hot = mine == 1, mine == 3
        reps = length[hot]
        nth = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps)
        self.first = np.concatenate([first[plain], np.repeat(first[hot], reps) + nth])
        self.length = np.concatenate([length[plain], np.ones(len(nth), np.int64)])
        self.text = np.concatenate([text[plain], np.repeat(text[hot], reps)])
        offset = np.concatenate([(anchor - first)[plain], np.repeat(anchor[hot], reps) - self.first[plain.sum() :]])
        width = 2 * span - gram
        content = _gather(self.data, self.first, self.length + span - 1, width)
        own = _digest(content, (self.length << 32) + offset)
        hot_only = np.arange(len(own)) >= plain.sum()
        deal = np.where(hot_only, own, np.concatenate([key[plain], np.repeat(key[hot], reps)]))
        deal = _mix(deal ^ np.uint64(0x5851F42D4C957F2D))
        order = np.lexsort((self.first, own, deal))
        same = (own[order][1:] == own[order][:-1]) & (deal[order][1:] == deal[order][:-1])
        same &= (content[order][1:] == content[order][:-1]).all(1) & (self.length[order][1:] == self.length[order][:-1])
        start = np.flatnonzero(np.r_[True, ~same]) if len(order) else np.empty(0, np.int64)
        self.piece = np.empty(len(order), np.int64)  # of each run: the distinct piece sent
        self.piece[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        self.least = np.minimum.reduceat(self.ids[self.text][order], start) if len(start) else np.empty(0, np.int64)
        rep = order[start]
        self.parts = slices(deal[rep], n)
        self.windows, self.offset, self.content = self.length[rep], offset[rep], content[rep]


def _gather(data: np.ndarray, first: np.ndarray, size: np.ndarray, width: int) -> np.ndarray:
    """Rows of ``width`` bytes from ``first`` on, zero beyond ``size``."""
    padded = np.concatenate([data, np.zeros(width, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, width)[first]
    out[np.arange(width) >= size[:, None]] = 0
    return out


def _digest(content: np.ndarray, extra: np.ndarray) -> np.ndarray:
    width = content.shape[1]
    padded = np.zeros((len(content), -(-width // 8) * 8), np.uint8)
    padded[:, :width] = content
    h = extra.astype(np.uint64)
    for column in padded.view(np.uint64).T:
        h = _mix(h * _C + column)
    return h


def _head(span: int) -> type:
    """The type of numbers of windows and offsets of a piece, which are below ``span``."""
    return np.uint8 if span <= 256 else np.uint32


def _send_pieces(n: int, span: int, gram: int):
    def send(docs: pa.Table, flags: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return rows([])
        s, b = _Sent(docs, flags, n, span, gram), docs.column("b")[0].as_py()
        used = np.arange(s.content.shape[1]) < (s.windows + span - 1)[:, None]
        out = []
        for bucket, x, y in s.parts:
            head = np.concatenate([s.windows[x:y], s.offset[x:y]]).astype(_head(span)).tobytes()
            out.append((bucket, b, head, s.least[x:y].tobytes(), s.content[x:y][used[x:y]].tobytes()))
        return rows(out)

    return send


def radix_groups(data: np.ndarray, suffix: np.ndarray, span: int) -> np.ndarray:
    """For each suffix (a place in ``data``) the group of its first ``span`` bytes; -1 for those that stand alone.

    Most-significant-digit passes of eight bytes: a pass sorts each open group by its next digit and closes what stands alone.
    """
    words = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    out = np.full(len(suffix), -1, np.int64)
    live, group = np.arange(len(suffix)), np.zeros(len(suffix), np.int64)
    for depth in range(0, span, 8):
        digit = np.ascontiguousarray(words[suffix[live] + min(depth, span - 8)]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((digit, group))
        live, digit, group = live[order], digit[order], group[order]
        new = np.r_[True, (digit[1:] != digit[:-1]) | (group[1:] != group[:-1])] if len(live) else np.empty(0, bool)
        group = np.cumsum(new) - 1
        alone = np.bincount(group)[group] == 1 if len(live) else np.empty(0, bool)
        live, group = live[~alone], group[~alone]
    out[live] = group
    return out


def _answer_pieces(span: int, gram: int):
    """By piece sent: the smallest id over its windows less the one sent; by window where windows of a piece differ."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("b")
        heads = [np.frombuffer(x, _head(span)).astype(np.int64).reshape(2, -1) for x in table.column("keys").to_pylist()]
        sizes = np.array([h.shape[1] for h in heads])
        windows, offset = np.concatenate(heads, axis=1)
        sent = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("more").to_pylist()])
        data = np.frombuffer(b"".join(table.column("content").to_pylist()), np.uint8)
        length = windows + span - 1
        first = np.cumsum(length) - length
        content = _gather(data, first, length, 2 * span - gram)
        own = _digest(content, (windows << 32) + offset)
        key = gram_hashes(data, gram)[first + offset]
        order = np.lexsort((own, key))
        same = (own[order][1:] == own[order][:-1]) & (windows[order][1:] == windows[order][:-1]) & (content[order][1:] == content[order][:-1]).all(1)
        start = np.flatnonzero(np.r_[True, ~same])
        kind = np.empty(len(order), np.int64)
        kind[order] = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(order))))
        least = np.minimum.reduceat(sent[order], start)
        rep = order[start]
        k = key[rep]
        shared = np.zeros(len(rep), bool)  # anchors with two kinds of surroundings: their windows are sorted
        equal = k[1:] == k[:-1]
        shared[1:] |= equal
        shared[:-1] |= equal
        sort = np.flatnonzero(shared)
        n = windows[rep[sort]]
        owner = np.repeat(sort, n)
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        group = radix_groups(data, first[rep[owner]] + nth, span)
        best = least[owner].copy()
        met = group >= 0
        if met.any():
            low = np.full(group.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(low, group[met], best[met])
            best[met] = low[group[met]]
        at_kind = np.full(len(rep) + 1, -1, np.int64)
        at_kind[sort] = np.cumsum(n) - n
        whole = least.copy()
        mixed = np.zeros(len(rep), bool)
        if len(sort):
            lo, hi = np.minimum.reduceat(best, at_kind[sort]), np.maximum.reduceat(best, at_kind[sort])
            whole[sort] = lo
            mixed[sort[lo != hi]] = True
        out, at = [], 0
        for bucket, b, size in zip(table.column("bucket").to_pylist(), table.column("b").to_pylist(), sizes.tolist(), strict=True):
            mine = kind[at : at + size]
            apart = np.flatnonzero(mixed[mine])
            m = windows[rep[mine[apart]]]
            i = np.repeat(at_kind[mine[apart]], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
            out.append((bucket, b, (whole[mine] - sent[at : at + size]).tobytes(), apart.astype(np.int32).tobytes(), best[i].tobytes()))
            at += size
        return rows(out)

    return answer


OUT = "doc_id long, spans array<struct<start: int, end: int>>, kept binary"


def _apply(n: int, span: int, gram: int):
    def apply(docs: pa.Table, told: pa.Table) -> pa.Table:
        second = pc.is_valid(told.column("more"))
        s = _Sent(docs, told.filter(pc.invert(second)), n, span, gram)
        told = told.filter(second)
        by = {r["bucket"]: r for r in told.to_pylist()}
        best = np.repeat(s.least, s.windows)
        at = np.cumsum(s.windows) - s.windows
        for bucket, x, y in s.parts:
            r = by[bucket]
            best[at[x] : at[x] + s.windows[x:y].sum()] += np.repeat(np.frombuffer(r["keys"], np.int64), s.windows[x:y])
            apart = np.frombuffer(r["more"], np.int32) + x
            m = s.windows[apart]
            best[np.repeat(at[apart], m) + np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)] = np.frombuffer(r["content"], np.int64)
        mark = np.zeros(len(s.data) + 1, np.int32)
        for x in range(0, len(s.first), 1 << 18):
            f, w, p = s.first[x : x + (1 << 18)], s.length[x : x + (1 << 18)], s.piece[x : x + (1 << 18)]
            nth = np.arange(w.sum()) - np.repeat(np.cumsum(w) - w, w)
            gone = best[np.repeat(at[p], w) + nth] < np.repeat(s.ids[s.text[x : x + (1 << 18)]], w)
            place = (np.repeat(f, w) + nth)[gone]
            np.add.at(mark, place, 1)
            np.subtract.at(mark, place + span, 1)
        removed = np.cumsum(mark[:-1], dtype=np.int32) > 0
        spans, kept, at0 = [], [], 0
        for t in s.texts:
            r = removed[at0 : at0 + len(t)]
            if r.any():
                edge = np.flatnonzero(np.diff(np.r_[False, r, False]))
                spans.append([{"start": a, "end": z} for a, z in edge.reshape(-1, 2).tolist()])
                kept.append(np.frombuffer(t, np.uint8)[~r].tobytes())
            else:
                spans.append([])
                kept.append(t)
            at0 += len(t)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        return pa.table({"doc_id": pa.array(s.ids, pa.int64(), mask=s.ids == NO_ID), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    return apply


def remove_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, hot: int = HOT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans, kept): the byte spans removed and the bytes left, one row per row of ``docs``. ``span`` is at least ``gram`` and 8."""
    if span < max(gram, 8):
        raise ValueError(f"span {span} is shorter than an anchor of {gram} bytes, or than 8 bytes")
    d, n = batched(docs, id_col, text_col, each=BATCH)
    by = d.groupBy("b")
    flags = by.applyInArrow(_send_keys(n, span, gram), ROW).groupBy("bucket").applyInArrow(_answer_keys(hot), ROW)
    pieces = by.cogroup(flags.groupBy("b")).applyInArrow(_send_pieces(n, span, gram), ROW)
    found = pieces.groupBy("bucket").applyInArrow(_answer_pieces(span, gram), ROW)
    return by.cogroup(flags.unionByName(found).groupBy("b")).applyInArrow(_apply(n, span, gram), OUT)
