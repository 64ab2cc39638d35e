"""Operator 4: byte-level BPE encoding by backtracking, decoding by an offset table.

``encode`` gives the ids that merging in rank order gives. Text is split by the vocabulary's pattern; within a piece an
Aho-Corasick automaton over all tokens finds the longest token at each place. The encoder takes the longest token there is,
keeps it if it is compatible with the token before it (no merge across their border would have come first), else tries the
next shorter prefix token, and steps back when none is left; places found to be dead ends are never tried again, so the work
is linear in the piece. Pair compatibility is looked up in a table that is filled on demand.

``decode`` copies each id's bytes out of one string of all tokens, by offsets.

Nulls and empty texts have no ids and decode to the empty string. Special tokens written in a text are recognised, as the
vocabulary file asks. Documents are handled row by row and whole, however long: ties, repeated rows, null ids and further columns
change nothing, and an empty table gives an empty one; the columns
added here win over input columns of the same name. The vocabulary is read by the driver and broadcast (its size is that of
the file, some 1.5 MB); the caches of pieces and pairs on an executor are bounded.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts, small_batches

PIECES = 150_000
PAIRS = 100_000
LONG = 48
#: Bytes of text or ids that an executor works on at a time.
PART = 1 << 20


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_chars() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    out = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(other)}
    return [out[b] for b in range(256)]


#: The split pattern of byte-level vocabularies (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def recent_characters() -> str:
    """Ranges, in pattern syntax, of letters and numbers that the pattern library knows and the tokenizers' does not yet."""
    import unicodedata

    import regex
    from tokenizers.pre_tokenizers import ByteLevel

    split = ByteLevel(add_prefix_space=False).pre_tokenize_str
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    doubtful = (c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn")
    codes = [ord(c) for c in doubtful if len(split(c + "!")) == 1]
    known = set(codes)
    first = [x for x in codes if x - 1 not in known]
    out = []
    for x in first:
        y = x
        while y + 1 in known:
            y += 1
        out.append(f"\\U{x:08x}-\\U{y:08x}")
    return "".join(out)


class Vocabulary:
    """Tables of one vocabulary. Ranks number the tokens: single bytes first, then results of merges in merge order."""

    def __init__(self, file: bytes, encoder: bool = True):
        model = json.loads(file)
        byte = {c: b for b, c in enumerate(byte_chars())}
        vocab = model["model"]["vocab"]
        self.added = {x["content"]: x["id"] for x in model.get("added_tokens", [])}
        by_id = {vocab[t]: bytes(byte[c] for c in t) for t in vocab} | {i: t.encode() for t, i in self.added.items()}
        n = max(by_id) + 1
        sizes = np.array([len(by_id.get(i, b"")) for i in range(n)], np.int64)
        self.offsets = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(by_id.get(i, b"") for i in range(n)), np.uint8)
        if encoder:
            self._encoder(model, byte)

    def _encoder(self, model: dict, byte: dict[str, int]) -> None:
        import ahocorasick
        import regex

        raw = lambda t: bytes(byte[c] for c in t).decode("latin-1")
        vocab, merges = model["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        rank: dict[str, int] = {}
        for t in sorted((t for t in vocab if len(t) == 1), key=vocab.__getitem__):
            rank[t] = len(rank)
        self.split: list[tuple[int, int]] = [(r, r) for r in range(len(rank))]
        self.joined: dict[int, int] = {}
        for a, b in merges:
            x, y = rank[a], rank[b]
            if a + b not in rank:
                rank[a + b] = len(rank)
                self.split.append((x, y))
            self.joined.setdefault(x << 32 | y, rank[a + b])
        self.packed = [np.uint32(vocab[t]).tobytes() for t in rank]
        text = [raw(t) for t in rank]
        self.length = [len(t) for t in text]
        place = {t: i for i, t in enumerate(text)}
        self.shorter = [next((place[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in place), -1) for t in text]
        self.tokens = ahocorasick.Automaton()
        for i, t in enumerate(text):
            self.tokens.add_word(t, i)
        self.tokens.make_automaton()
        self.single = {t: self.packed[i] for t, i in place.items() if len(t) <= LONG}
        self.find = regex.compile(PATTERN).findall
        recent = recent_characters()
        self.recent = regex.compile(f"[{recent}]").search if recent else None
        self.late = regex.compile("[\u0530-\U0010ffff]").search  # no character before these is recent
        if recent:
            old = PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{recent}]]")
            old = old.replace(r"?\p{L}+", rf"?[\p{{L}}--[{recent}]]+").replace(r"?\p{N}+", rf"?[\p{{N}}--[{recent}]]+")
            self.find_old = regex.compile(old, regex.V1).findall
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self.pieces: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether merging in rank order leaves ``a`` and ``b`` side by side: undo the later merge again and again, and see
        whether the tokens at the border would have merged before it. The answer goes into the table of pairs."""
        x, y, limit, split, joined = a, b, 1 << 40, self.split, self.joined
        while True:
            if joined.get(x << 32 | y, limit) < limit:
                ok = False
                break
            right, left = split[x][1], split[y][0]
            if x > y:  # the merge that made x came later
                if right != x:
                    limit, x = x, right
                else:
                    ok = True
                    break
            elif left != y:
                limit, y = y + 1, left
            elif right != x:
                limit, x = x, right
            else:
                ok = True
                break
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        self.pairs[a << 32 | b] = ok
        return ok

    def piece(self, text: str) -> bytes:
        """The packed ids of one piece; bytes stand as Latin-1 characters."""
        n = len(text)
        longest = [-1] * n
        length, packed, shorter, pairs, compatible = self.length, self.packed, self.shorter, self.pairs, self.compatible
        for end, token in self.tokens.iter(text):
            at = end + 1 - length[token]
            if longest[at] < 0 or length[longest[at]] < length[token]:
                longest[at] = token
        alive = bytearray(b"\1" * (n + 1))
        out: list[int] = []
        at, token = 0, longest[0]
        while at < n:
            while token >= 0:
                end = at + length[token]
                if alive[end]:
                    if not out:
                        break
                    fits = pairs.get(out[-1] << 32 | token)
                    if fits or (fits is None and compatible(out[-1], token)):
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            else:  # no way on from here: step back and try what is shorter than the token before
                alive[at] = 0
                last = out.pop()
                at -= length[last]
                token = shorter[last]
        return b"".join([packed[t] for t in out])

    def plain(self, text: str) -> bytes:
        """The packed ids of a text without special tokens."""
        known, single, out = self.pieces, self.single, []
        old = self.recent and not text.isascii() and self.late(text) and self.recent(text)
        for p in (self.find_old if old else self.find)(text):
            ids = known.get(p)
            if ids is None:
                raw = p if p.isascii() else p.encode().decode("latin-1")
                ids = single.get(raw) or self.piece(raw)
                if len(p) <= LONG:
                    if len(known) >= PIECES:
                        known.clear()
                    known[p] = ids
            out.append(ids)
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        if self.special is None or not self.special.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [self.plain(text[at : m.start()]), np.uint32(self.added[m[0]]).tobytes()]
            at = m.end()
        return b"".join([*out, self.plain(text[at:])])

    def decode(self, packed: list[bytes]) -> list[str]:
        """Texts of several documents at once; malformed UTF-8 becomes U+FFFD."""
        ids = np.frombuffer(b"".join(packed), np.uint32)
        first, size = self.offsets[ids], self.offsets[ids + np.uint32(1)] - self.offsets[ids]
        end = np.cumsum(size)
        data = self.bytes[np.repeat(first - (end - size), size) + np.arange(end[-1] if len(end) else 0)].tobytes()
        ends = np.concatenate([[0], end])[np.cumsum([0] + [len(p) // 4 for p in packed])].tolist()
        return [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]


_LOADED: dict[tuple[int, bool], Vocabulary] = {}


def _vocabulary(file, encoder: bool) -> Vocabulary:
    key = (hash(file.value), encoder)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(file.value, encoder)
    return _LOADED[key]


def _broadcast(df: DataFrame, path: str | None):
    with open(path or default_path(), "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens (long) and ids (binary: little-endian unsigned 32-bit integers); without its text if asked for."""
    file = _broadcast(docs, path)
    small_batches(docs.sparkSession)
    d = docs.drop("n_tokens", "ids")
    kept = d.columns if keep_text else [c for c in d.columns if c != text_col]
    names = [*kept, "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(file, True)
        for b in parts(batches, text_col, PART):
            packed = [v.encode(t) if t else b"" for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([len(p) // 4 for p in packed], pa.int64()), pa.array(packed, pa.binary())], names=names)

    return d.mapInArrow(run, d.select(*kept, F.lit(0).cast("long").alias("n_tokens"), F.lit(b"").alias("ids")).schema)


def decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with decoded_text (string), for packed ids as ``encode`` gives them; null counts as no ids."""
    file = _broadcast(encoded, path)
    small_batches(encoded.sparkSession)
    d = encoded.drop("decoded_text")
    names = [*d.columns, "decoded_text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(file, False)
        for b in parts(batches, ids_col, PART):
            out = v.decode([p or b"" for p in b.column(ids_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], names=names)

    return d.mapInArrow(run, d.select("*", F.lit("").alias("decoded_text")).schema)
