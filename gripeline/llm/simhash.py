"""Operator 3: SimHash near-duplicates over a Gray-ordered hierarchical index.

1. ``fingerprints``: bit b is 1 when it is set in over half of the hashes of a text's word shingles.
2. Equal fingerprints are collapsed, so exact copies never meet in pairs. The graph's nodes are fingerprints, not ids: rows of one
   id with different texts, or without one, are as many nodes, and a component is named by the smallest id among its rows.
3. Two fingerprints that differ in at most d bits agree on at least ``blocks - d`` of ``blocks`` bit blocks. Every choice of
   that many blocks is a mask; a mask and the bits under it are an upper node of the index, and nodes are dealt out by hash.
   There are as few blocks as leave a node some 64 fingerprints (``blocks_for``): 5 masks of some 13 bits below half a million
   fingerprints, 15 of some 21 bits below 170 million, 35 of some 27 bits below 12 billion; every choice finds the same links.
4. Below an upper node fingerprints stand in Gray order. Runs of 16, and runs of 16 such runs, form the lower levels: a run
   keeps the mask of bits that all its members share and their pattern there. A query goes down the levels adding up the
   differences found under each mask and leaves a whole run as soon as they pass d.
5. Links found below one node are reduced there to a star on the node's smallest id, so no node emits all its pairs.
   Connected components over the stars then run as joins.

Step 3 loses nothing but is only affordable for few bits. ``similar_texts`` and ``first_of_similar`` link exactly those texts whose
sets of shingles have a Jaccard similarity of ``similarity`` or more, of which many differ in more bits. They begin with the index: each
fingerprint (of a set) meets the nearest one before it below each of its upper nodes, and these pairs are checked by their whole sets.
What is so linked need not meet again; the rest is found beside it. Shingles are told apart, and sets collapsed, by 64 bits of hash; the rest is exact:

1. Batches of documents count their shingles and learn from buckets how many documents have each (see ``blocks``): to the power of
   two, which is enough for one order of all shingles, rare ones first.
2. Of two sets that similar, each has one of the other's shingles among its first ``n - ceil(similarity * n) + 1`` (prefix
   filter), and sizes and places of the first such shingle bound what they share. Shingles that one document alone has find
   nothing and are not sent, so a text without much in common with others sends next to nothing.
3. Below a shingle that more than CROWD prefixes have, every set first meets a few leaders, those with the fewest shingles of their
   own: of a large group of near copies the ones nearest to what all have in common, and the same ones below each shingle. What
   is linked then need not meet again, so such a group costs no square of its size. A second round takes leaders from what is left.
4. All other pairs below a shingle that are not yet in one component are compared by their whole sets, unless the counts of their
   hashes in 256 buckets rule that out. Sets are built anew from the texts for that, as all of them take more disk than the texts.

An upper node with more than ``hot`` fingerprints is split: its members fall into s parts, and each pair of parts is one piece
of work. Nulls and texts without words have fingerprint zero and are linked like any other; repeated rows share a fingerprint
and so a component; a document without an id is linked, and its component is null if none of its documents has one; an empty table
gives an empty result. Ids are whole numbers; a text of any length is fingerprinted in one task. Extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import ROW, batched, groups, in_order, pack_counts, pack_sorted, places, rows, slices, texts_of, unpack_counts, unpack_sorted
from .shared import LOWER_ASCII, Cuts, connected_components, parts, small_batches

SEED = 42
RUN = 16
#: Stands for a null id while ids are plain numbers: above all others, so that a component is named by an id if it has one.
NO_ID = (1 << 63) - 1


def shingle_hashes(text: str | bytes | None, size: int) -> np.ndarray:
    """XXH64 of each shingle of ``size`` words, A-Z in lower case; the whole sequence if it has fewer words."""
    import xxhash

    found = (text if isinstance(text, bytes) else (text or "").encode()).translate(LOWER_ASCII).split()
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    if len(found) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    lengths = np.fromiter(map(len, found), np.int64, len(found)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[: len(found) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)


def majority(hashes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of ``hashes``; runs are not empty."""
    out = np.zeros(len(starts), np.uint64)
    for bit in range(64):
        ones = np.add.reduceat((hashes >> np.uint64(bit)) & np.uint64(1), starts)
        out |= (2 * ones > sizes).astype(np.uint64) << np.uint64(bit)
    return out


#: Sets below one shingle that meet pair by pair; leaders; rounds in which crowds meet leaders only; bytes of text of a batch.
CROWD, LEADERS, ROUNDS, BATCH = 32, 3, 2, 4 << 20
#: Up to so many rows the names of the sets to compare are broadcast, else dealt out by hash.
BROADCAST_ROWS = 1_000_000


def _of_sets(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprint of each array of hashes, zero where it is empty."""
    out = np.zeros(len(hashes), np.uint64)
    sizes = np.array([len(h) for h in hashes], np.int64)
    full = np.flatnonzero(sizes)
    if len(full):
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]])
        out[full] = majority(np.concatenate(hashes), starts, sizes[full].astype(np.uint64))
    return out


def _of_texts(texts: list, size: int) -> np.ndarray:
    out = np.zeros(len(texts), np.uint64)
    at = 0
    while at < len(texts):  # some 200,000 shingles at a time
        hashes, n, first = [], 0, at
        while at < len(texts) and n < 200_000:
            hashes.append(shingle_hashes(texts[at], size))
            n += len(hashes[-1])
            at += 1
        out[first:at] = _of_sets(hashes)
    return out


def row_key(id_col: str = "doc_id", text_col: str = "text") -> list[Column]:
    """(id, row), never null: the id or NO_ID, and a hash of the text. Rows that agree in both are repeated rows."""
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text_col).alias("row")]


def fingerprints(docs: DataFrame, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): the 64-bit fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text", 4 << 20):
            fp = _of_texts(b.column(1).to_pylist(), shingle_words)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    return docs.select(row_key(id_col, text_col)[0], F.col(text_col).alias("text")).mapInArrow(run, "id long, fp long")


SET = "id long, row long, node long, n int, spread binary, fp long"


def _name(h: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(h.tobytes(), SEED)


def shingle_sets(docs: DataFrame, shingle_words: int, id_col: str, text_col: str) -> DataFrame:
    """SET: besides id and row a hash that names the set, its size, how its hashes spread over 256 buckets, and its fingerprint."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches, "text", 1 << 20):
            sets = [np.unique(shingle_hashes(t, shingle_words)) for t in b.column(2).to_pylist()]
            name = np.array([_name(h) for h in sets], np.uint64).view(np.int64)
            spread = [np.minimum(np.bincount((h >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes() for h in sets]
            more = [pa.array(name), pa.array([len(h) for h in sets], pa.int32()), pa.array(spread, pa.binary()), pa.array(_of_sets(sets).view(np.int64))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], names=[x.split()[0] for x in SET.split(", ")])

    return docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).mapInArrow(run, SET)


class _Sets:
    """The different sets of a batch of documents, and how often each of their shingles occurs in it."""

    def __init__(self, docs: pa.Table, size: int):
        sets = {_name(h): h for h in (np.unique(shingle_hashes(t, size)) for t in texts_of(in_order(docs))) if len(h)}
        self.names = np.array(list(sets), np.uint64).view(np.int64)
        self.sizes = np.fromiter(map(len, sets.values()), np.int64, len(sets))
        self.every = np.concatenate([np.empty(0, np.uint64), *sets.values()])
        self.keys, self.place, self.count = np.unique(self.every, return_inverse=True, return_counts=True)


def _send_counts(n: int, size: int):
    def send(docs: pa.Table) -> pa.Table:
        s, b = _Sets(docs, size), docs.column("b")[0].as_py()
        return rows([(bucket, b, pack_sorted(s.keys[x:y]), pack_counts(s.count[x:y]), None) for bucket, x, y in slices(s.keys, n)])

    return send


def _answer_classes(table: pa.Table) -> pa.Table:
    """By shingle sent: the logarithm of how many sets have it, one in each batch that has the same."""
    table = table.sort_by("b")
    keys = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    k = np.concatenate(keys)
    count = np.concatenate([unpack_counts(x) for x in table.column("more").to_pylist()])
    order = np.argsort(k)
    start = groups(k[order])
    total = np.add.reduceat(count[order], start)
    each = np.log2(total).astype(np.int64)[places(order, start)]
    at = np.cumsum([0, *map(len, keys)])
    names = zip(table.column("bucket").to_pylist(), table.column("b").to_pylist(), strict=True)
    return rows([(bucket, b, pack_counts(each[at[i] : at[i + 1]]), None, None) for i, (bucket, b) in enumerate(names)])


FIRST = "k long, node long, n int, place int, own int"


def _first(n: int, size: int, similarity: float):
    """FIRST: a row for each of the first shingles of a set that other sets have too; ``own`` is how many it has alone."""

    def first(docs: pa.Table, told: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({x.split()[0]: pa.array([], pa.int64() if x.endswith("long") else pa.int32()) for x in FIRST.split(", ")})
        s = _Sets(docs, size)
        by = dict(zip(told.column("bucket").to_pylist(), told.column("keys").to_pylist(), strict=True))
        each = np.zeros(len(s.keys), np.int64)
        for bucket, x, y in slices(s.keys, n):
            each[x:y] = unpack_counts(by[bucket])
        each = each[s.place]
        owner = np.repeat(np.arange(len(s.sizes)), s.sizes)
        order = np.lexsort((s.every, each, owner))
        start = np.cumsum(s.sizes) - s.sizes
        place = np.arange(len(owner)) - start[owner]
        own = np.add.reduceat((each == 0).astype(np.int64), start) if len(start) else start
        limit = s.sizes - np.ceil(similarity * s.sizes - 1e-9).astype(np.int64) + 1
        keep = (place < limit[owner]) & (each[order] > 0)
        who = owner[keep]
        return pa.table({
            "k": s.every[order][keep].view(np.int64), "node": s.names[who], "n": s.sizes[who].astype(np.int32), "place": place[keep].astype(np.int32),
            "own": own[who].astype(np.int32),
        })

    return first


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows sorted by their first, in blocks of about 100,000 rows that split no group."""
    held: list[list[np.ndarray]] = []
    n = 0
    for b in batches:
        held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
        n += b.num_rows
        if n >= 100_000:
            cols = [np.concatenate(x) for x in zip(*held, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            if last:
                yield [c[:last] for c in cols]
                cols = [c[last:].copy() for c in cols]
            held, n = [cols], len(cols[0])
    if held and n:
        yield [np.concatenate(x) for x in zip(*held, strict=True)]


def _candidates(similarity: float, crowds: bool, step: int = 1 << 20):
    """Sorted rows (k, own, node, n, place, c) to pairs (a, b) of different c that may be similar; of crowds only those with a leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, own, node, n, place, c in _whole_groups(batches):
            new = np.r_[True, (k[1:] != k[:-1]) | (node[1:] != node[:-1])]  # a set is met once, in however many batches it is
            k, own, node, n, place, c = (x[new] for x in (k, own, node, n, place, c))
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.append(starts, len(k)))
            every = np.arange(len(k))
            lo = np.repeat(starts, sizes)
            if crowds:
                every = every[np.repeat(sizes > CROWD, sizes)]
                if not len(every):
                    continue
                # leaders: the first sets of the first components that stand below k
                order = np.lexsort((every, c[every], lo[every]))
                e = every[order]
                lead = np.sort(e[np.r_[True, (c[e][1:] != c[e][:-1]) | (lo[e][1:] != lo[e][:-1])]])
                first = np.flatnonzero(np.r_[True, lo[lead][1:] != lo[lead][:-1]])
                nth = np.arange(len(lead)) - np.repeat(first, np.diff(np.append(first, len(lead))))
            work = np.cumsum(np.full(len(every), LEADERS) if crowds else every - lo[every])
            at = 0
            while at < len(every):
                to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + step)))
                q = every[at:to]
                at = to
                if crowds:
                    i, j = (np.concatenate(x) for x in zip(*(_of_group(lead[nth == x], lo, q) for x in range(LEADERS)), strict=True))
                else:
                    i, j = _expand(lo[q], q)
                    i = q[i]
                may = (c[i] != c[j]) & (np.minimum(n[i] - place[i], n[j] - place[j]) * (1 + similarity) >= (n[i].astype(np.int64) + n[j]) * similarity - 1e-9)
                if may.any():
                    pairs = np.unique(np.stack([np.minimum(node[i[may]], node[j[may]]), np.maximum(node[i[may]], node[j[may]])]), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return run


def _of_group(lead: np.ndarray, lo: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places q, and for each the one of ``lead`` in its group; without those whose group has none."""
    at = np.searchsorted(lo[lead], lo[q])
    there = at < len(lead)
    there[there] = lo[lead[at[there]]] == lo[q[there]]
    return q[there], lead[at[there]]


def _spreads(similarity: float):
    """Rows (a, b, x, y, n, m) to those (a, b) that may be similar: sets share at most the lesser count of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(-1, 256) for i in (2, 3))
            least = np.minimum(x, y)
            n = b.column(4).to_numpy().astype(np.int64) + b.column(5).to_numpy()
            may = pa.array((least.sum(1, dtype=np.int64) * (1 + similarity) >= n * similarity - 1e-9) | (least == 255).any(1))  # 255: or more
            yield pa.RecordBatch.from_arrays([b.column(0).filter(may), b.column(1).filter(may)], names=["a", "b"])

    return run


def _similar(similarity: float, size: int):
    """Rows (a, b, x, y) to those (a, b) whose texts x and y have similar sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, a, x = [], None, None
            for one, s, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if one != a:
                    a, x = one, np.unique(shingle_hashes(s, size))
                y = np.unique(shingle_hashes(t, size))
                both = np.sort(np.concatenate([x, y]), kind="stable")
                n = int((both[1:] == both[:-1]).sum())
                near.append(n >= similarity * (len(x) + len(y) - n) - 1e-9)
            near = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(near), b.column(1).filter(near)], names=["a", "b"])

    return run


def similar_links(docs: DataFrame, sets: DataFrame, similarity: float, shingle_words: int, id_col: str, text_col: str, cuts: Cuts, bits: int = 4) -> DataFrame:
    """Edges (a, b) that connect exactly those nodes of ``sets`` (of ``docs``) linked by sets of that Jaccard similarity.

    The first come from the index over fingerprints that differ in at most ``bits`` bits, the others from the prefix filter.
    """
    keyed_docs = docs.select(F.xxhash64(id_col, text_col).alias("id"), F.col(text_col).alias("text"))
    d, n = batched(keyed_docs, "id", "text", each=BATCH)
    by = d.groupBy("b")
    classes = by.applyInArrow(_send_counts(n, shingle_words), ROW).groupBy("bucket").applyInArrow(_answer_classes, ROW)
    keyed = cuts.cut(by.cogroup(classes.groupBy("b")).applyInArrow(_first(n, shingle_words, similarity), FIRST))
    of = cuts.cut(sets.groupBy("node").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("spread").alias("spread"), F.first("fp").alias("fp")))

    def both(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
        for node, new in (("b", "2"), ("a", "1")):
            pairs = pairs.join(table.select(F.col("node").alias(node), *(F.col(c).alias(c + new) for c in columns)), node)
        return pairs

    def compare(below: DataFrame, crowds: bool) -> DataFrame:
        met = below.select("k", "own", "node", "n", "place", "c").repartition("k").sortWithinPartitions("k", "own", "node")
        return checked(met.mapInArrow(_candidates(similarity, crowds), "a long, b long").distinct())

    def checked(pairs: DataFrame) -> DataFrame:
        pairs = cuts.cut(both(pairs, of, "n", "spread").select("a", "b", "spread1", "spread2", "n1", "n2").mapInArrow(_spreads(similarity), "a long, b long"))
        needed = cuts.cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(of.select("node", "row"), "node"))
        names = F.broadcast(needed) if needed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else needed
        texts = docs.select(F.xxhash64(text_col).alias("row"), F.col(text_col).alias("text")).join(names, "row").select("node", "text")
        texts = cuts.cut(texts.groupBy("node").agg(F.min("text").alias("text")))
        out = cuts.cut(both(pairs, texts, "text").select("a", "b", "text1", "text2").mapInArrow(_similar(similarity, shingle_words), "a long, b long"))
        cuts.drop(pairs, needed, texts)
        return out

    edges = checked(fingerprint_pairs(of.select("node", "fp"), bits, cuts))
    for last in (*[False] * ROUNDS, True):
        linked = connected_components(edges, cuts)
        edges = edges.unionByName(compare(keyed.join(linked, "node", "left").withColumn("c", F.coalesce("component", "node")), not last))
    cuts.drop(keyed, of)
    return edges


def masks(bits: int, blocks: int) -> list[int]:
    """The masks of all choices of ``blocks - bits`` of ``blocks`` near-equal blocks of 64 bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(blocks)]
    return [sum(block[i] for i in c) for c in combinations(range(blocks), blocks - bits)]


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


def _levels(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of up to RUN neighbours inside [start, end) of each parent: first, end, shared mask and pattern; all parents at once."""
    n_runs = -(-(ends - starts) // RUN)
    parent = np.repeat(np.arange(len(starts)), n_runs)
    nth = np.arange(len(parent)) - np.repeat(np.cumsum(n_runs) - n_runs, n_runs)
    first = starts[parent] + nth * RUN
    end = np.minimum(first + RUN, ends[parent])
    return first, end, parent, n_runs


def _expand(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each i the numbers lo[i]..hi[i]-1: the i, and the numbers."""
    n = hi - lo
    i = np.repeat(np.arange(len(lo)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + lo[i]


def linked_pairs(codes: np.ndarray, starts: np.ndarray, bits: int, step: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (later, earlier) of places in ``codes`` that lie in one group and differ in at most ``bits`` bits.

    Groups begin at ``starts``; within a group codes are in Gray order.
    """
    ends = np.append(starts[1:], len(codes))
    one, end1, group, n_one = _levels(codes, starts, ends)  # runs of codes
    if not len(one):
        return
    lowest, highest = np.bitwise_and.reduceat(codes, one), np.bitwise_or.reduceat(codes, one)
    mask1 = ~(lowest ^ highest)
    first1 = np.cumsum(n_one) - n_one
    two, end2, group2, n_two = _levels(codes, first1, first1 + n_one)  # runs of runs
    low2, high2 = np.bitwise_and.reduceat(lowest, two), np.bitwise_or.reduceat(highest, two)
    mask2 = ~(low2 ^ high2)
    first2 = np.cumsum(n_two) - n_two
    of = np.repeat(np.arange(len(starts)), ends - starts)
    # a query meets only what stands before it, so it visits its group's upper nodes up to its own
    own2 = first2[of] + (np.arange(len(codes)) - starts[of]) // (RUN * RUN)
    work = np.cumsum(own2 - first2[of] + 1)
    at = 0
    while at < len(codes):
        to = max(at + 1, int(np.searchsorted(work, (work[at - 1] if at else 0) + step // RUN)))
        q, node = _expand(first2[of[at:to]], own2[at:to] + 1)
        q += at
        acc = np.bitwise_count((codes[q] ^ low2[node]) & mask2[node])
        keep = acc <= bits
        q, node, acc = q[keep], node[keep], acc[keep]
        i, child = _expand(two[node], end2[node])
        q, node, acc = q[i], node[i], acc[i]
        keep = one[child] < q
        q, node, acc, child = q[keep], node[keep], acc[keep], child[keep]
        acc = acc + np.bitwise_count((codes[q] ^ lowest[child]) & mask1[child] & ~mask2[node])
        keep = acc <= bits
        q, child, acc = q[keep], child[keep], acc[keep]
        for a in range(0, len(q), step // RUN):
            i, leaf = _expand(one[child[a : a + step // RUN]], end1[child[a : a + step // RUN]])
            i += a
            keep = leaf < q[i]
            i, leaf = i[keep], leaf[keep]
            near = np.bitwise_count(codes[q[i]] ^ codes[leaf]) <= bits
            if near.any():
                yield q[i][near], leaf[near]
        at = to


def local_roots(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]], values: np.ndarray) -> np.ndarray:
    """For each of n places the smallest of ``values`` in its component over ``pairs``; memory is bounded by n and one block."""
    label = np.arange(n)
    for a, b in pairs:
        while True:
            x, y = label[a], label[b]
            differ = x != y
            if not differ.any():
                break
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label = up
    least = values.copy()
    np.minimum.at(least, label, values)
    return least[label]


def _stars(bits: int):
    """Sorted rows (key, fp) to edges (a, b) between the fingerprints below each node."""

    def links(k: np.ndarray, ids: np.ndarray) -> pa.RecordBatch | None:
        order = np.lexsort((gray_rank(ids.view(np.uint64)), k))
        k, ids = k[order], np.ascontiguousarray(ids[order])
        codes = ids.view(np.uint64)
        starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        sizes = np.diff(np.append(starts, len(k)))
        many = np.repeat(sizes > 1, sizes)
        if not many.any():
            return None
        codes, ids, sizes = codes[many], ids[many], sizes[sizes > 1]
        starts = np.cumsum(sizes) - sizes
        root = local_roots(len(ids), linked_pairs(codes, starts, bits), ids)
        linked = root != ids
        return pa.RecordBatch.from_arrays([pa.array(ids[linked]), pa.array(root[linked])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        n = 0
        for b in batches:
            held.append([c.to_numpy(zero_copy_only=False) for c in b.columns])
            n += b.num_rows
            if n >= 100_000:  # all but the last group, which may go on
                cols = [np.concatenate(x) for x in zip(*held, strict=True)]
                last = int(np.searchsorted(cols[0], cols[0][-1]))
                if last:
                    if (out := links(*(c[:last] for c in cols))) is not None:
                        yield out
                    cols = [c[last:].copy() for c in cols]
                held, n = [cols], len(cols[0])
        if held and (out := links(*(np.concatenate(x) for x in zip(*held, strict=True)))) is not None:
            yield out

    return run


def _nearest(bits: int):
    """Sorted rows (key, fp) to pairs (a, b): each fingerprint, and of those before it below the same node the nearest within ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, fp in _whole_groups(batches):
            order = np.lexsort((gray_rank(fp.view(np.uint64)), k))
            k, codes = k[order], fp.view(np.uint64)[order]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            sizes = np.diff(np.append(starts, len(k)))
            codes, sizes = codes[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
            near = np.full(len(codes), NO_ID)
            for later, earlier in linked_pairs(codes, np.cumsum(sizes) - sizes, bits):
                np.minimum.at(near, later, np.bitwise_count(codes[later] ^ codes[earlier]).astype(np.int64) << 40 | earlier)
            found = np.flatnonzero(near != NO_ID)
            of = near[found] & ((1 << 40) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(codes[found].view(np.int64)), pa.array(codes[of].view(np.int64))], names=["a", "b"])

    return run


def blocks_for(n: int, bits: int, each: int = 64) -> int:
    """The fewest blocks with which an upper node holds at most ``each`` of n evenly spread fingerprints on average."""
    return next((b for b in range(bits + 1, 64) if n <= each << (64 * (b - bits) // b)), 64)


def index_links(items: DataFrame, bits: int, blocks: int, cuts: Cuts, hot: int = 8192, below=_stars) -> DataFrame:
    """Edges (a, b) that connect exactly those fingerprints of ``items`` (fp, distinct) that at most ``bits`` differing bits link.

    ``below`` makes them of what lies below one node: stars, or with ``_nearest`` pairs that differ in so few bits themselves.
    """
    rows = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("p")) for i, m in enumerate(masks(bits, blocks)))))
    keyed = items.select("fp", rows.alias("n")).select(F.xxhash64("n.m", "n.p").alias("k"), "fp")
    return grouped_links(keyed, bits, cuts, hot, below)


def fingerprint_pairs(nodes: DataFrame, bits: int, cuts: Cuts) -> DataFrame:
    """Pairs (a, b) of ``nodes`` (node, fp): those of near fingerprints, by the first node of each, and nodes of one fingerprint with its first."""
    items = cuts.cut(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    near = index_links(items.select("fp"), bits, blocks_for(items.count(), bits), cuts, below=_nearest).distinct()
    first = lambda c: items.select(F.col("fp").alias(c), F.col("first").alias(f"{c}_first"))
    pairs = near.join(first("a"), "a").join(first("b"), "b").select("a_first", "b_first")
    pairs = pairs.union(nodes.join(items, "fp").where("node != first").select("first", "node"))
    return pairs.select(F.least("a_first", "b_first").alias("a"), F.greatest("a_first", "b_first").alias("b")).distinct()


def grouped_links(keyed: DataFrame, bits: int, cuts: Cuts, hot: int = 8192, below=_stars) -> DataFrame:
    """Edges that connect the fingerprints of ``keyed`` (k, fp) which share a k and differ in at most ``bits`` bits."""
    crowded = cuts.cut(keyed.groupBy("k").count().where(F.col("count") > hot).select("k", F.ceil(F.col("count") * 2 / hot).cast("int").alias("s")))
    if crowded.limit(1).count():
        part = F.pmod(F.xxhash64("fp"), F.col("s")).cast("int")
        split = F.explode(F.when(F.col("s").isNull(), F.array(F.lit(None).cast("long"))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("s") - 1), lambda j: F.least(j, part).cast("long") * F.col("s") + F.greatest(j, part))
        ))
        keyed = keyed.join(crowded, "k", "left").select("k", "fp", split.alias("x"))
        keyed = keyed.select(F.when(F.col("x").isNull(), F.col("k")).otherwise(F.xxhash64("k", "x")).alias("k"), "fp")
    return keyed.repartition("k").sortWithinPartitions("k").mapInArrow(below(bits), "a long, b long")


def near_duplicates(
    docs: DataFrame, bits: int = 4, blocks: int | None = None, shingle_words: int = 4, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``; the component is the smallest id reachable over links."""
    none = F.lit(NO_ID)
    out = [F.nullif("id", none).alias("doc_id"), "fp", F.nullif("component_id", none).alias("component_id")]
    cuts = Cuts(docs.sparkSession, "simhash")
    fps = cuts.cut(fingerprints(docs, shingle_words, id_col, text_col))
    items = cuts.cut(fps.groupBy("fp").agg(F.min("id").alias("id")))
    edges = cuts.cut(index_links(items.select("fp"), bits, blocks or blocks_for(items.count(), bits), cuts))
    linked = items.join(connected_components(edges, cuts), F.col("fp") == F.col("node")).select("fp", "id", "component")
    least = linked.groupBy("component").agg(F.min("id").alias("component_id"))
    linked = cuts.cut(linked.join(least, "component").select("fp", "component_id"))
    named = cuts.cut(items.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "id").alias("component_id")))
    cuts.drop(items, edges, linked)
    return fps.join(named, "fp").select(*out)


def _similar_groups(docs: DataFrame, similarity: float, shingle_words: int, id_col: str, text_col: str, cuts: Cuts) -> DataFrame:
    """(id, row, component): one row per row of ``docs``; a component is named by a node, so it needs no id."""
    sets = cuts.cut(shingle_sets(docs, shingle_words, id_col, text_col))
    rows = sets.select("id", "row", "node")
    found = connected_components(similar_links(docs, sets, similarity, shingle_words, id_col, text_col, cuts), cuts)
    done = cuts.cut(rows.join(found, "node", "left").select("id", "row", F.coalesce("component", "node").alias("component")))
    cuts.drop(sets)
    return done


def similar_texts(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, component_id): one row per row of ``docs``; links are the pairs of texts of that Jaccard similarity or more."""
    found = _similar_groups(docs, similarity, shingle_words, id_col, text_col, Cuts(docs.sparkSession, "simhash"))
    least = found.groupBy("component").agg(F.min("id").alias("component_id"))
    none = F.lit(NO_ID)
    return found.join(least, "component").select(F.nullif("id", none).alias("doc_id"), F.nullif("component_id", none).alias("component_id"))


def first_of_similar(docs: DataFrame, similarity: float = 0.8, shingle_words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, row) as of ``row_key``: of each group of similar texts the row of smallest id, those without an id last, then of smallest hash."""
    found = _similar_groups(docs, similarity, shingle_words, id_col, text_col, Cuts(docs.sparkSession, "simhash"))
    return found.groupBy("component").agg(F.min(F.struct("id", "row")).alias("first")).select("first.id", "first.row")
