"""Operator 11: byte-level BPE by a rank file, merging by a segment tree; decoding by taking tokens.

``encode`` gives the ids that the rank file's own library gives without special tokens. A text is split by the vocabulary's
pattern. Within a piece, a segment tree over byte positions holds at each position the rank of the pair that begins there, and
at its root the leftmost pair of smallest rank. A merge takes out the right token of that pair and sets three points anew: the
merged pair's place, its live neighbour before it, and the place that is no longer the start of a token. Each point costs the
tree's height, so a piece of n bytes takes O(n log n), however long it is. A piece that is a token by itself needs no merge.

A space between two characters that are not white space always begins a piece, and what follows it does not depend on what
stands before. So a text is looked up by such stretches first; only stretches not met lately are split and merged.

``decode`` takes the tokens' bytes from one Arrow array by ids; the result is bytes, as ids need not end at a character.

Nulls and empty texts have no ids and decode to no bytes. Texts are handled whole and row by row, so ties, repeated rows, null
ids and further columns change nothing, and an empty table gives an empty one; columns added here win over input columns of the
same name. A long text takes memory in proportion to its length, some 40 bytes for each byte of its longest piece. An id that
the vocabulary lacks stops ``decode`` with an error. The rank file is read by the driver and broadcast (it is what it is, some
0.8 MB); the caches of stretches and pieces on an executor are bounded.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, small_batches

CACHED = 150_000
LONG = 48
#: Bytes of text, or ids, that an executor works on at a time.
PART = 1 << 20
#: Pieces up to these sizes are merged side by side, so many at a time; longer ones each by itself.
WIDTHS = (8, 16, 32)
SIDE_BY_SIDE = 8192
NONE = 1 << 62
PLACE = (1 << 32) - 1


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def default_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def unknown_to_library() -> dict[str, str]:
    """By class, the ranges of letters and numbers, in pattern syntax, that the pattern library knows and the rank file's library does not yet."""
    import regex
    import tiktoken

    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    out = {}
    for kind in (r"\p{L}", r"\p{N}"):
        known = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
        codes = {ord(c) for c in regex.findall(kind, every)} - {ord(c) for c in bytes(known.encode_ordinary(every)).decode()}
        first = sorted(x for x in codes if x - 1 not in codes)
        last = sorted(x for x in codes if x + 1 not in codes)
        out[kind] = "".join(f"\\U{a:08x}-\\U{z:08x}" for a, z in zip(first, last, strict=True))
    return out


class Ranks:
    """Tables of one rank file, and caches."""

    def __init__(self, file: bytes, pattern: str, unknown: dict[str, str]):
        import regex

        self.rank = {base64.b64decode(token): int(n) for token, n in map(bytes.split, file.splitlines()) if token}
        by_id = {n: token for token, n in self.rank.items()}
        self.tokens = pa.array([by_id.get(i) for i in range(max(by_id) + 1)], pa.large_binary())
        self.byte_rank = np.array([self.rank.get(bytes([i]), 0) for i in range(256)], np.int64)
        pairs = ((self.rank[t[:i]] << 32 | self.rank[t[i:]], n) for t, n in self.rank.items() for i in range(1, len(t)) if t[:i] in self.rank and t[i:] in self.rank)
        pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
        self.pair_keys, self.pair_ranks = (np.ascontiguousarray(x) for x in pairs.T) if len(pairs) else (np.array([-1]), np.array([0]))
        self.find = regex.compile(pattern).findall
        for kind, ranges in unknown.items():
            pattern = pattern.replace(kind, f"[{kind}--[{ranges}]]") if ranges else pattern
        self.find_known = regex.compile(pattern, regex.V1).findall
        self.unknown = regex.compile(f"[{''.join(unknown.values())}]").search if any(unknown.values()) else None
        self.white = frozenset(regex.findall(r"\s", "".join(map(chr, range(0x3001)))))
        self.loose = regex.compile(r"\A | \s|\s | \Z").search
        self.stretches: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        n, rank = len(piece), self.rank.get
        size = 1 << max(n - 2, 0).bit_length()
        tree = array("q", [NONE]) * (2 * size)
        for i in range(n - 1):
            r = rank(piece[i : i + 2])
            if r is not None:
                tree[size + i] = r << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = array("q", range(1, n + 2)), array("q", range(-1, n))

        def put(i: int, end: int) -> None:
            """The pair at ``i`` now reaches to ``end``; 0: there is none."""
            r = rank(piece[i:end]) if end else None
            key = NONE if r is None else r << 32 | i
            i += size
            tree[i] = key
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                if b < a:
                    a = b
                if tree[i] == a:
                    return
                tree[i] = a

        while tree[1] < NONE:
            i = tree[1] & PLACE
            gone = after[i]
            end = after[gone]
            after[i], before[end] = end, i
            if gone < n - 1:
                put(gone, 0)
            put(i, after[end] if end < n else 0)
            if before[i] >= 0:
                put(before[i], end)
        out, i = [], 0
        while i < n:
            out.append(self.rank[piece[i : after[i]]])
            i = after[i]
        return out

    def merge_many(self, raw: list[bytes], width: int) -> list[bytes]:
        """The packed ids of pieces of ``width`` bytes at most (a power of two): their trees stand side by side, and a step takes one
        merge in each piece that has one left."""
        rows = len(raw)
        sizes = np.array([len(x) for x in raw], np.int64)
        filled = np.arange(width) < sizes[:, None]
        token = np.zeros((rows, width + 1), np.int64)
        token[:, :width][filled] = self.byte_rank[np.frombuffer(b"".join(raw), np.uint8)]
        after = np.broadcast_to(np.arange(1, width + 2), token.shape).copy()
        before = np.broadcast_to(np.arange(-1, width), token.shape).copy()
        none, bits = np.iinfo(np.int64).max, width.bit_length()
        tree = np.full((rows, 2 * width), none, np.int64)
        row, i = np.nonzero(filled[:, 1:])
        tree[row, width + i] = self.pair_rank(token[row, i], token[row, i + 1], none >> bits) << bits | i
        tree[tree >> bits == none >> bits] = none
        for level in range(width.bit_length() - 2, -1, -1):
            tree[:, 1 << level : 2 << level] = np.minimum(tree[:, 2 << level : 4 << level : 2], tree[:, (2 << level) + 1 : 4 << level : 2])
        token, after, before, tree = (x.reshape(-1) for x in (token, after, before, tree))
        live = np.arange(rows)
        while True:
            root = tree[live * (2 * width) + 1]
            has = root != none
            live, root = live[has], root[has]
            if not len(live):
                break
            at, base = live * (width + 1), live * (2 * width)
            i, n = root & ((1 << bits) - 1), sizes[live]
            gone = after[at + i]
            end = after[at + gone]
            token[at + i], after[at + i], before[at + end] = root >> bits, end, i
            left = before[at + i]
            right = self.pair_rank(token[at + i], token[at + np.minimum(end, width)], none >> bits)
            right[end >= n] = none >> bits
            first = self.pair_rank(token[at + np.maximum(left, 0)], token[at + i], none >> bits)
            points = [(gone, np.full(len(live), none)), (i, right << bits | i), (np.where(left >= 0, left, i), np.where(left >= 0, first << bits | left, right << bits | i))]
            nodes = []
            for place, key in points:
                key[key >> bits == none >> bits] = none
                node = width + np.minimum(place, width - 1)
                keep = place < width
                tree[(base + node)[keep]] = key[keep]
                nodes.append(node)
            for _ in range(width.bit_length() - 1):
                nodes = [node >> 1 for node in nodes]
                for node in nodes:
                    tree[base + node] = np.minimum(tree[base + 2 * node], tree[base + 2 * node + 1])
        starts = np.zeros((rows, width + 2), bool)
        token, after = token.reshape(rows, -1), after.reshape(rows, -1)
        live, place = np.arange(rows), np.zeros(rows, np.int64)
        while len(live):  # follow the live tokens
            starts[live, place] = True
            place = after[live, place]
            more = place < sizes[live]
            live, place = live[more], place[more]
        ids = token.astype(np.int32)[starts[:, :-1]].tobytes()
        ends = np.append(0, 4 * np.cumsum(starts.sum(1))).tolist()
        return [ids[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def pair_rank(self, a: np.ndarray, b: np.ndarray, none: int) -> np.ndarray:
        """The rank of the token that two tokens make, ``none`` where they make none."""
        key = a << 32 | b
        at = np.searchsorted(self.pair_keys, key)
        at[at == len(self.pair_keys)] = 0
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], none)

    def add_pieces(self, found: set[str]) -> None:
        """Fills the cache of pieces with those of ``found``."""
        waiting: dict[int, list] = {w: [] for w in WIDTHS}
        for p in found.difference(self.pieces):
            raw = p.encode()
            whole = self.rank.get(raw)
            if whole is not None:
                self.pieces[p] = whole.to_bytes(4, "little")
            elif len(raw) > WIDTHS[-1]:
                self.pieces[p] = np.array(self.merge(raw), np.int32).tobytes()
            else:
                waiting[next(w for w in WIDTHS if len(raw) <= w)].append((p, raw))
        for width, some in waiting.items():
            for k in range(0, len(some), SIDE_BY_SIDE):
                part = some[k : k + SIDE_BY_SIDE]
                self.pieces.update(zip([p for p, _ in part], self.merge_many([raw for _, raw in part], width), strict=True))

    def stretches_of(self, text: str) -> list[str]:
        """A text cut at spaces that stand between two characters that are not white space; these spaces are left out."""
        found = text.split(" ")
        if self.loose(text):  # a space beside white space: what stands on both sides of it is one stretch
            ends = [bool(x) and x[-1] not in self.white for x in found]
            at = [0, *(i for i in range(1, len(found)) if ends[i - 1] and found[i] and found[i][0] not in self.white), len(found)]
            found = [" ".join(found[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """The packed ids (signed 32-bit integers) of each text."""
        for cache in (self.stretches, self.pieces):
            if len(cache) > CACHED:
                cache.clear()
        known, pieces = self.stretches, self.pieces
        found = [self.stretches_of(t) for t in texts]
        new = sorted(set(chain.from_iterable(x[1:] for x in found)).difference(known))
        split = []
        for x in chain((" " + x for x in new), (x[0] for x in found)):
            split.append((self.find_known if self.unknown and not x.isascii() and self.unknown(x) else self.find)(x))
        here = set(chain.from_iterable(split))
        self.add_pieces(here)
        packed = [b"".join(map(pieces.__getitem__, x)) for x in split]
        known.update(zip(new, packed))
        out = [b"".join([first, *map(known.__getitem__, x[1:])]) for first, x in zip(packed[len(new) :], found, strict=True)]
        for cache, added in ((known, new), (pieces, here)):
            for x in added:
                if len(x) > LONG:
                    del cache[x]
        return out


_LOADED: dict[int, Ranks] = {}


def _ranks(sent) -> Ranks:
    key = hash(sent.value)
    if key not in _LOADED:
        _LOADED.clear()
        file, pattern, *classes = sent.value
        _LOADED[key] = Ranks(file, pattern, dict(classes))
    return _LOADED[key]


def _broadcast(df: DataFrame, path: str | None, pattern: str | None):
    with open(path or default_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast((f.read(), pattern or default_pattern(), *unknown_to_library().items()))


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens (long) and ids (array of int); without its text if asked for."""
    sent = _broadcast(docs, path, pattern)
    small_batches(docs.sparkSession)
    d = docs.drop("n_tokens", "ids")
    kept = d.columns if keep_text else [c for c in d.columns if c != text_col]
    names = [*kept, "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = _ranks(sent)
        for b in parts(batches, text_col, PART):
            packed = ranks.encode([t or "" for t in b.column(text_col).to_pylist()])
            sizes = np.array([len(p) // 4 for p in packed], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(np.frombuffer(b"".join(packed), np.int32)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(sizes), ids], names=names)

    return d.mapInArrow(run, d.select(*kept, F.lit(0).cast("long").alias("n_tokens"), F.array(F.lit(0)).alias("ids")).schema)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", keep_ids: bool = True) -> DataFrame:
    """``encoded`` with decoded (binary), for arrays of ids as ``encode`` gives them; null counts as no ids."""
    sent = _broadcast(encoded, path, None)
    small_batches(encoded.sparkSession)
    d = encoded.drop("decoded")
    kept = d.columns if keep_ids else [c for c in d.columns if c != ids_col]
    names = [*kept, "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = _ranks(sent).tokens
        for b in batches:
            lists = b.column(ids_col)
            ends = lists.offsets.to_numpy().astype(np.int64)
            at = 0
            while at < b.num_rows:  # as many rows as hold some PART ids, one at least
                to = max(at + 1, int(np.searchsorted(ends, ends[at] + PART, "right")) - 1)
                taken = tokens.take(lists.values[ends[at] : ends[to]])
                starts = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset :][: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
                bounds = starts[ends[at : to + 1] - ends[at]].astype(np.int32)
                out = pa.Array.from_buffers(pa.binary(), to - at, [None, pa.py_buffer(bounds.tobytes()), taken.buffers()[2]])
                part = b.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), out], names=names)
                at = to

    return d.mapInArrow(run, d.select(*kept, F.lit(b"").alias("decoded")).schema)
