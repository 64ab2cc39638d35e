"""Operator 10: language-model scores by stupid backoff, every document scored by the counts of all others.

The counts are tables of n-grams (orders 1 to 3) over all documents, partitioned by n-gram hash. N-grams of the documents are
exploded, joined to those tables, turned into scores and summed by document. A document's own n-grams are taken off the counts
before it is scored, so that what only it says counts as unseen:

    s(w | u v) = c(u v w) / c(u v)         if c(u v w) > 0
               = 0.4 s(w | v)              else
    s(w | v)   = c(v w) / c(v)             if c(v w) > 0
               = 0.4 s(w)                  else
    s(w)       = max(c(w), 1) / max(N, 1)

Words are those between ASCII white space, A-Z in lower case; the first word of a document has no context and the second one
word. Nulls and texts without words have no words, log_score 0 and mean_log_score null. Each row of a repeated document is one
more document. Ids are whole numbers, and may be null or repeated. A text of any length belongs to one batch, and is scored whole by
one task. An empty table gives an empty result; extra columns are ignored.

Both sides of the join travel as packed blocks (see ``blocks``): a batch of documents sends each distinct n-gram once with its
number, the bucket of a hash range adds the numbers up and answers with the totals. An n-gram of order 3 is only sent when both
its halves occur twice, else it occurs once. N-grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .blocks import ROW, batched, groups, in_order, pack_counts, pack_sorted, places, rows, slices, texts_of, unpack_counts, unpack_sorted
from .shared import LOWER_ASCII

ALPHA = 0.4
_C = np.uint64(0x9E3779B97F4A7C15)


_INVERSE = np.uint64(pow(int(_C), -1, 1 << 64))
_RNG = np.random.default_rng(10)
_BYTE = _RNG.integers(1 << 63, size=256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BLANK = np.zeros(256, bool)
_BLANK[list(b" \t\n\x0b\x0c\r")] = True


def _mix(z: np.ndarray) -> np.ndarray:
    z = z ^ (z >> np.uint64(30))
    z *= np.uint64(0xBF58476D1CE4E5B9)
    z ^= z >> np.uint64(27)
    z *= np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word of each text, and the number of words of each text.

    All bytes at once: with running sums S of byte values times powers of an odd number, a word's hash is the difference of S at
    its ends, divided by the power at its start.
    """
    data = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER_ASCII), np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(np.r_[True, blank, True]))
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    sizes = np.diff(np.searchsorted(start, ends), prepend=0)
    out = np.empty(len(start), np.uint64)
    step = 1 << 16  # words at a time, powers counted from the first of them
    for a in range(0, len(start), step):
        s, e = start[a : a + step], end[a : a + step]
        part = data[s[0] : e[-1]]
        power = np.full(len(part), _C)
        power[:1] = 1
        np.multiply.accumulate(power, out=power)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[part] * power, dtype=np.uint64)])
        inverse = np.full(len(part), _INVERSE)
        inverse[:1] = 1
        np.multiply.accumulate(inverse, out=inverse)
        s, e = s - s[0], e - s[0]
        out[a : a + step] = _mix((total[e] - total[s]) * inverse[s] + (e - s).astype(np.uint64))
    return out, sizes


class _Keys:
    """The distinct n-grams of a batch in ascending order, their numbers, and the place of each occurrence among them."""

    def __init__(self, every: np.ndarray):
        order = np.argsort(every)
        start = groups(every[order])
        self.keys = every[order][start]
        self.place = places(order, start)
        self.count = np.diff(np.append(start, len(order)))

    def rows(self, n: int, b: int) -> list[tuple]:
        return [(bucket, b, pack_sorted(self.keys[x:y]), pack_counts(self.count[x:y]), None) for bucket, x, y in slices(self.keys, n)]

    def totals(self, told: pa.Table, n: int) -> np.ndarray:
        by = dict(zip(told.column("bucket").to_pylist(), told.column("keys").to_pylist(), strict=True))
        out = self.count.copy()
        for bucket, x, y in slices(self.keys, n):
            out[x:y] += unpack_counts(by[bucket])
        return out


class _Grams:
    """The n-grams of a batch; ``at`` is each word's place in its document."""

    def __init__(self, docs: pa.Table):
        docs = in_order(docs)
        self.ids = docs.column("id")
        words, self.sizes = word_hashes(texts_of(docs))
        self.doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.at = np.arange(len(words)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        one = _mix(words + np.uint64(1))
        two = _mix(one[:-1] * _C + one[1:] + np.uint64(2)) if len(one) else one
        self.three = _mix(two[:-1] * _C + one[2:] + np.uint64(3)) if len(one) > 1 else one[:0]
        self.has2, self.has3 = np.flatnonzero(self.at >= 1), np.flatnonzero(self.at >= 2)
        # orders 1 and 2, and one n-gram of order 0 that stands for all words
        self.low = _Keys(np.concatenate([one, two[self.has2 - 1], np.full(len(words) and 1, 7, np.uint64)]))
        if len(words):
            self.low.count[self.low.place[-1]] = len(words)

    def high(self, total: np.ndarray) -> tuple[np.ndarray, _Keys]:
        """The words at which an n-gram of order 3 ends that can occur twice, and these: both its halves occur twice."""
        twice = np.zeros(len(self.at), bool)
        twice[self.has2] = total[self.low.place[len(self.at) : len(self.at) + len(self.has2)]] > 1
        ends = self.has3[twice[self.has3] & twice[self.has3 - 1]]
        return ends, _Keys(self.three[ends - 2])


def _send_low(n: int):
    def send(table: pa.Table) -> pa.Table:
        return rows(_Grams(table).low.rows(n, table.column("b")[0].as_py()))

    return send


def _send_high(n: int):
    def send(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return rows([])
        g = _Grams(docs)
        return rows(g.high(g.low.totals(told, n))[1].rows(n, docs.column("b")[0].as_py()))

    return send


def _answer(order: bytes):
    """By n-gram sent: how often the other batches have it. ``order`` marks the round."""

    def answer(table: pa.Table) -> pa.Table:
        table = table.sort_by("b")
        keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
        k = np.concatenate(keys)
        count = np.concatenate([unpack_counts(x) for x in table.column("more").to_pylist()])
        by = np.argsort(k)
        start = groups(k[by])
        other = np.add.reduceat(count[by], start)[places(by, start)] - count
        at = np.cumsum([0, *map(len, keys)])
        names = zip(table.column("bucket").to_pylist(), table.column("b").to_pylist(), strict=True)
        return rows([(bucket, b, pack_counts(other[at[i] : at[i + 1]]), order, None) for i, (bucket, b) in enumerate(names)])

    return answer


def _score(n: int, alpha: float):
    def score(docs: pa.Table, told: pa.Table) -> pa.Table:
        g = _Grams(docs)
        low = pc.equal(told.column("more"), pa.scalar(b"low"))
        total = g.low.totals(told.filter(low), n)
        ends, high = g.high(total)
        words = len(g.doc)

        def elsewhere(keys: _Keys, total: np.ndarray, doc: np.ndarray) -> np.ndarray:
            """For each occurrence how often other documents have its n-gram."""
            own = keys.place[: len(doc)] * np.int64(len(g.sizes)) + doc
            order = np.argsort(own)
            start = groups(own[order])
            return total[keys.place[: len(doc)]] - np.diff(np.append(start, len(order)))[places(order, start)]

        c = elsewhere(g.low, total, np.concatenate([g.doc, g.doc[g.has2]]))
        c1, c2, c3 = c[:words], np.zeros(words, np.int64), np.zeros(words, np.int64)
        c2[g.has2] = c[words:]
        c3[ends] = elsewhere(high, high.totals(told.filter(pc.invert(low)), n), g.doc[ends])
        rest = np.maximum((total[g.low.place[-1]] if words else 0) - g.sizes[g.doc], 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            s = np.maximum(c1, 1) / rest
            before1, before2 = np.r_[0, c1[:-1]], np.r_[0, c2[:-1]]
            s = np.where(g.at >= 1, np.where(c2 > 0, c2 / before1, alpha * s), s)
            s = np.where(g.at >= 2, np.where(c3 > 0, c3 / before2, alpha * s), s)
        sums = np.bincount(g.doc, np.log(s), len(g.sizes)) if words else np.zeros(len(g.sizes))
        mean = pa.array(np.where(g.sizes > 0, sums / np.maximum(g.sizes, 1), 0), mask=g.sizes == 0)
        return pa.table({"doc_id": g.ids, "n_words": pa.array(g.sizes), "log_score": pa.array(sums), "mean_log_score": mean})

    return score


def stupid_backoff(docs: DataFrame, alpha: float = ALPHA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, log_score, mean_log_score): one row per row of ``docs``, natural logarithms."""
    d, n = batched(docs, id_col, text_col)
    by = d.groupBy("b")
    low = by.applyInArrow(_send_low(n), ROW).groupBy("bucket").applyInArrow(_answer(b"low"), ROW)
    high = by.cogroup(low.groupBy("b")).applyInArrow(_send_high(n), ROW).groupBy("bucket").applyInArrow(_answer(b"high"), ROW)
    return by.cogroup(low.unionByName(high).groupBy("b")).applyInArrow(_score(n, alpha), "doc_id long, n_words long, log_score double, mean_log_score double")
