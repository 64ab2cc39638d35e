"""Byte-level BPE by segment trees against the rank file's library; centroids against plain Python."""

import base64
import hashlib
import math

import numpy as np
import pytest

from gripeline.llm import bytebpe, centroids

TEXTS = [
    "Hello  world\n\n it's the 1st test!", "<|endoftext|>a<|endoftext|> ", "", None, "é😀漢字 ñandú　\x1c\x85", "a" * 3000, " " * 500 + "x", "thththndtily " * 200, "ab" * 500, "꟎՘ Ɤ", "'s 'S don't we'll",
    " ", "a ", "\n a 　 b\x85 c\x00", "same same same", "z\U00011de0 9\U00011de0", "é   x",
]


def library():
    import public_tokenizers
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(bytebpe.default_path(), "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def own():
    with open(bytebpe.default_path(), "rb") as f:
        return bytebpe.Ranks(f.read(), bytebpe.default_pattern(), bytebpe.unknown_to_library())


def test_byte_bpe(spark):
    t = library()
    d = spark.createDataFrame([(None if i % 5 == 0 else i, x, "old") for i, x in enumerate(TEXTS * 2)], "doc_id long, text string, ids string")
    encoded = bytebpe.encode(d)
    rows = bytebpe.decode(encoded).collect()
    assert sorted(str(r["text"]) for r in rows) == sorted(str(x) for x in TEXTS * 2)
    for r in rows:
        want = t.encode_ordinary(r["text"] or "")
        assert r["ids"] == want and r["n_tokens"] == len(want) and bytes(r["decoded"]) == t.decode_bytes(want) == (r["text"] or "").encode()
    assert bytebpe.decode(bytebpe.encode(d.limit(0))).count() == 0
    assert set(bytebpe.encode(d, keep_text=False).columns) == {"doc_id", "n_tokens", "ids"}
    odd = bytebpe.decode(spark.createDataFrame([(1, [220]), (2, None), (3, [])], "doc_id long, ids array<int>"), keep_ids=False).collect()
    assert {r["doc_id"]: bytes(r["decoded"]) for r in odd} == {1: t.decode_bytes([220]), 2: b"", 3: b""}


def test_byte_bpe_hypothesis():
    from hypothesis import given, settings
    from hypothesis import strategies as st

    t, ranks = library(), own()

    @settings(max_examples=300, deadline=None)
    @given(st.lists(st.text(st.characters(exclude_categories=("Cs",)), max_size=80) | st.text("abeinrst '\n12　", max_size=80), min_size=1, max_size=5))
    def same(texts):
        assert [np.frombuffer(p, np.int32).tolist() for p in ranks.encode(texts)] == [t.encode_ordinary(x) for x in texts]

    same()


def test_byte_bpe_trees(monkeypatch):
    """One tree for a long piece and trees side by side give the same; caches that overflow lose nothing."""
    t, ranks = library(), own()
    some = [b"thththndtily", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", b"a", b"ab", " é".encode(), bytes(range(128, 150))]
    for width in (32, 64):
        assert [np.frombuffer(x, np.int32).tolist() for x in ranks.merge_many(some, width)] == [ranks.merge(x) for x in some]
    monkeypatch.setattr(bytebpe, "CACHED", 2)
    monkeypatch.setattr(bytebpe, "SIDE_BY_SIDE", 2)
    for _ in range(3):
        texts = [x or "" for x in TEXTS]
        assert [np.frombuffer(p, np.int32).tolist() for p in ranks.encode(texts)] == [t.encode_ordinary(x) for x in texts]


@pytest.mark.parametrize("text", ["x" * 200_000, "a\n" * 300_000, "wort " * 100_000])
def test_byte_bpe_long(text):
    assert np.frombuffer(own().encode([text])[0], np.int32).tolist() == library().encode_ordinary(text)


def plain_clusters(rows, k, rounds, size, scale, seed):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(scale * float(np.float32(x))) for x in v]
            if max(map(abs, x)) < centroids.LARGEST:
                kept.append((i, x))
    first = sorted(("~" if i is None else hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), x) for i, x in kept)[:k]
    c = [x for _, x in first]
    gap = lambda a, b: sum((p - q) ** 2 for p, q in zip(a, b))
    for turn in range(rounds + 1):
        own = [min(range(len(c)), key=lambda j: (gap(x, c[j]), j)) for _, x in kept]
        if turn < rounds:
            for j in range(len(c)):
                mine = [x for o, (_, x) in zip(own, kept) if o == j]
                if mine:
                    c[j] = [sum(y) // len(mine) for y in zip(*mine)]
    d = [gap(x, c[o]) for o, (_, x) in zip(own, kept)]
    inertia = {j: sum(y for o, y in zip(own, d) if o == j) for j in set(own)}
    return sorted((str(i), o, y, inertia[o], sum(d), c[o]) for (i, _), o, y in zip(kept, own, d))


def test_centroids(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(scale=2, size=4).tolist()) for i in range(150)]
    rows += [(500 + i, [0.25, -0.25, 0.5, 0.0]) for i in range(60)] + [(7, [9.0, 9.0, 9.0, 9.0])] * 2 + [(None, [1.0, 1.0, 1.0, -1.0])] * 2
    rows += [(600, None), (601, []), (602, [1.0] * 5), (603, [1.0, None, 1.0, 1.0]), (604, [math.nan] * 4), (605, [math.inf] * 4), (606, [2e6, 1e6, -2e6, 5.0])]
    d = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster string").repartition(7)
    got = centroids.cluster(d, k=9, rounds=3, size=4, scale=16, seed=1).collect()
    want = plain_clusters(rows, 9, 3, 4, 16, 1)
    assert sorted((str(r["vec_id"]), r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid"]) for r in got) == want
    large = centroids.cluster(spark.createDataFrame([(1, [3e9] * 4), (2, [1.0] * 4)], "vec_id long, embedding array<float>"), k=3, size=4).collect()
    assert {r["vec_id"]: (r["cluster"], r["distance"]) for r in large} == {1: (None, None), 2: (0, 0)}
    assert centroids.cluster(d.limit(0)).count() == 0 and centroids.cluster(d.where("vec_id = 601")).count() == 0


@pytest.mark.parametrize("reach", [3, 2000, centroids.LARGEST - 1])
def test_screening_is_exact(reach):
    """Ties, near ties and numbers that single precision cannot hold: the intervals hold the exact distance, the nearest is exact."""
    rng = np.random.default_rng(reach)
    c = rng.integers(-reach, reach + 1, (12, 64))
    c[5], c[7] = c[2], c[2]
    c[8, 0] += 1
    x = np.concatenate([rng.integers(-reach, reach + 1, (300, 64)), c, (c[:6] + c[6:]) // 2])
    exact = np.array([[sum((int(p) - int(q)) ** 2 for p, q in zip(a, b)) for b in c] for a in x], object)
    own, distance, n = centroids.nearest(x, c)
    assert distance.tolist() == exact.min(1).tolist() and own.tolist() == [r.tolist().index(min(r)) for r in exact]
    low, high = centroids.intervals(x, c)
    square = np.array([sum(int(p) ** 2 for p in a) for a in x], object)[:, None]
    assert all(int(math.floor(a)) <= e - s <= int(math.ceil(b)) for a, b, e, s in zip(low.ravel(), high.ravel(), exact.ravel(), np.broadcast_to(square, exact.shape).ravel()))
    assert len(x) <= n < len(x) * len(c)
