"""Operator 2: substring deduplication by line, paragraph and sentence hashing.

A text falls into units. Units are normalised (lower case, single blanks between words) and digested to 128 bits; the earliest
occurrence of a digest in the order (document id, place in the text) stays and all later ones are removed. Lines and
paragraphs count from one word on. Sentences within a line count too, so that a passage is found where it begins or ends within
a line: those of ``min_words`` words or more on their own, shorter ones only next to a unit that is removed. Whatever is removed
therefore stands, in normalised form, at an earlier place.

Nulls and texts without words have no units and come back unchanged. Ids are whole numbers; rows of equal id rank by their text,
rows without an id come before all others, in an order by hash of their texts. A text of any length is read whole, by one task.
Columns of the input are kept; the columns added here win over input columns of the same name. An empty table gives an empty result.

Digests are first gathered by batch of documents (see ``blocks``): a line that is in a third of all documents costs one record
for each batch, and the answer to a batch is whether it holds the earliest occurrence.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import ROW, answered, batched, groups, ids_of, in_order, pack_sorted, places, rows, slices, unpack_sorted

MIN_WORDS = 6
_SENTENCE = re.compile(r"[^.!?]*[.!?]+(?=\s|$)\s*|[^.!?]+$|[^.!?]*[.!?]+")
_PARAGRAPH = re.compile(r"\n[ \t\r\f\v]*\n")


LINE, PARENT, SENTENCE, SHORT = range(4)


def units(text: str, level: str = "line", min_words: int = MIN_WORDS) -> list[tuple[int, int, bytes, int]]:
    """(start, end, normalised, kind) of the units of a text, in characters; the sentences of a line that has several follow it."""
    out: list[tuple[int, int, bytes, int]] = []
    at = 0
    pieces = text.split("\n") if level == "line" else _PARAGRAPH.split(text)
    for piece in pieces:
        if level != "line":
            at = text.index(piece, at)
        found = piece.lower().split()
        if found:
            parts = [(m.start(), m.end(), w) for m in _SENTENCE.finditer(piece) if (w := m[0].lower().split())]
            several = len(parts) > 1
            out.append((at, at + len(piece), " ".join(found).encode(), PARENT if several else LINE))
            for a, b, words in parts if several else ():
                out.append((at + a, at + b, ("\x01" + " ".join(words)).encode(), SENTENCE if len(words) >= min_words else SHORT))
        at += len(piece) + (level == "line")
    return out


def chosen(found: list[tuple[int, int, int]], repeated: list[bool]) -> list[bool]:
    """Which units (start, end, kind) go, given which are repeats: short sentences only beside one that goes."""
    out = [r and k != SHORT for r, (_, _, k) in zip(repeated, found, strict=True)]
    end = -1
    for i, (start, stop, kind) in enumerate(found):
        if kind == PARENT:
            end = stop if out[i] else -1
        elif kind != LINE and start < end:
            out[i] = True
    atoms = [i for i, x in enumerate(found) if x[2] != PARENT]
    for order in (atoms, atoms[::-1]):
        for before, i in zip(order, order[1:], strict=False):
            out[i] = out[i] or (out[before] and repeated[i])
    return out


class _Units:
    def __init__(self, docs: pa.Table, level: str, min_words: int):
        import xxhash

        self.docs = in_order(docs)
        self.ids = ids_of(self.docs)
        self.texts = self.docs.column("text").to_pylist()
        digest = xxhash.xxh3_128_digest
        spans, data, sizes = [], [], []
        for t in self.texts:
            found = units(t, level, min_words) if t else []
            spans += [(a, b, k) for a, b, _, k in found]
            data += [digest(x) for _, _, x, _ in found]
            sizes.append(len(found))
        self.spans = spans
        self.sizes = np.array(sizes, np.int64)
        both = np.frombuffer(b"".join(data), np.uint64).reshape(-1, 2)
        high, low = both[:, 1].copy(), both[:, 0].copy()
        order = np.lexsort((low, high))  # stable: in a run of equal digests the first is the earliest
        start = groups(high[order], low[order])
        self.first = order[start]
        self.high, self.low = high[self.first], low[self.first]
        self.least = np.repeat(self.ids, self.sizes)[self.first]
        self.place = places(order, start)


def _send(n: int, level: str, min_words: int):
    def send(table: pa.Table) -> pa.Table:
        u, b = _Units(table, level, min_words), table.column("b")[0].as_py()
        return rows([(bucket, b, pack_sorted(u.high[x:y]), u.low[x:y].tobytes(), u.least[x:y].tobytes()) for bucket, x, y in slices(u.high, n)])

    return send


def _answer(table: pa.Table) -> pa.Table:
    """By digest sent: 1 if the batch has the earliest occurrence."""
    table = table.sort_by("b")
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    high = np.concatenate(keys)
    low = np.concatenate([np.frombuffer(x, np.uint64) for x in table.column("more").to_pylist()])
    least = np.concatenate([np.frombuffer(x, np.int64) for x in table.column("content").to_pylist()])
    order = np.lexsort((least, low, high))
    own = np.zeros(len(high), np.uint8)
    own[order[groups(high[order], low[order])]] = 1
    at = np.cumsum([0, *sizes])
    return rows([(bucket, b, own[at[i] : at[i + 1]].tobytes(), None, None) for i, (bucket, b) in enumerate(zip(table.column("bucket").to_pylist(), table.column("b").to_pylist(), strict=True))])


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _apply(n: int, level: str, min_words: int):
    def apply(docs: pa.Table, told: pa.Table) -> pa.Table:
        u = _Units(docs, level, min_words)
        own = answered(told, slices(u.high, n), np.uint8, len(u.high))
        gone = np.ones(len(u.place), bool)
        gone[u.first[own == 1]] = False
        removed, kept = [], []
        at = 0
        for t, size in zip(u.texts, u.sizes.tolist(), strict=True):
            merged: list[list[int]] = []
            mine = gone[at : at + size]
            going = chosen(u.spans[at : at + size], mine.tolist()) if mine.any() else []
            for a, b, _ in (x for x, g in zip(u.spans[at : at + size], going, strict=False) if g):
                if merged and a <= merged[-1][1]:
                    merged[-1][1] = max(b, merged[-1][1])
                elif merged and t[merged[-1][1] : a] == "\n":
                    merged[-1][1] = b
                else:
                    merged.append([a, b])
            at += size
            removed.append([{"start": a, "end": b} for a, b in merged])
            if merged:
                out, last = [], 0
                for a, b in merged:
                    out.append(t[last:a])
                    last = b + 1 if t[b : b + 1] == "\n" and (a == 0 or t[a - 1] == "\n") else b
                t = "".join([*out, t[last:]])
            kept.append(t)
        return pa.table({"row": u.docs.column("row"), "removed_spans": pa.array(removed, _SPANS), "kept_text": pa.array(kept, pa.string()), "text": u.docs.column("text"), "n_units": pa.array(u.sizes)})

    return apply


def remove_repeated_units(docs: DataFrame, level: str = "line", min_words: int = MIN_WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with n_units (long), removed_spans (character offsets in the text as it was) and kept_text.

    ``level`` is "line" or "paragraph" (blank lines part paragraphs).
    """
    d, n = batched(docs, id_col, text_col, keep=True)
    by = d.groupBy("b")
    flags = by.applyInArrow(_send(n, level, min_words), ROW).groupBy("bucket").applyInArrow(_answer, ROW)
    kind = d.schema["row"].dataType.simpleString()
    out = by.cogroup(flags.groupBy("b")).applyInArrow(_apply(n, level, min_words), f"row {kind}, removed_spans array<struct<start: int, end: int>>, kept_text string, text string, n_units long")
    new = ("n_units", "removed_spans", "kept_text")
    return out.select(*(F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns if c not in new), *new)
