"""Near-duplicates, units and suffixes against brute force."""

import hashlib
import random

import numpy as np
import plain
import pytest
import xxhash

from gripeline.llm import simhash, suffixes, units
from gripeline.llm.shared import Cuts, connected_components

WORDS = [f"w{i}" for i in range(400)]


def texts(seed=0, n=60, long=80):
    r = random.Random(seed)
    base = [" ".join(r.choices(WORDS, k=r.randint(1, long))) for _ in range(n)]
    out = list(enumerate(base))
    for i in range(n):  # copies with an edit or none
        w = base[r.randrange(n)].split(" ")
        if i % 3:
            w[r.randrange(len(w))] = "edit"
        out.append((1000 + i, " ".join(w)))
    return [*out, (-1, None), (-2, ""), (-3, " \n"), (5000, "One two"), (5001, "one TWO"), (5001, "one TWO"), (6000, "É one"), (6001, "é one")]


def fingerprint(t, k):
    w = (t or "").encode().translate(simhash.LOWER_ASCII).split()
    s = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))] if w else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(pairs, nodes):
    up = {n: n for n in nodes}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((root(a), root(b)))
        up[b] = a
    return {n: root(n) for n in nodes}


def test_simhash(spark):
    rows = texts()
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, fp int")
    got = simhash.near_duplicates(d).collect()
    fp = [(i, fingerprint(t, 4)) for i, t in rows]
    want = components([(a, b) for n, (a, x) in enumerate(fp) for b, y in fp[:n] if bin(x ^ y).count("1") <= 4], {i for i, _ in rows})
    assert len(got) == len(rows)
    assert sorted((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == sorted((i, x, want[i]) for i, x in fp)
    assert simhash.near_duplicates(d.limit(0)).count() == 0


@pytest.mark.parametrize(("hot", "blocks"), [(8192, 6), (40, 6), (8192, 5), (40, 5), (8192, 7)])
def test_index_finds_every_link(spark, hot, blocks):
    r = np.random.default_rng(1)
    centre = r.integers(1 << 62, size=30, dtype=np.uint64)
    near = np.repeat(centre, 12)
    for _ in range(3):
        near = near ^ (np.uint64(1) << r.integers(64, size=len(near), dtype=np.uint64))
    big = np.repeat(r.integers(1 << 62, size=1, dtype=np.uint64), 400)
    for _ in range(2):
        big = big ^ (np.uint64(1) << r.integers(64, size=len(big), dtype=np.uint64))
    codes = np.unique(np.concatenate([centre, near, big]))
    ids = codes.view(np.int64).tolist()
    items = spark.createDataFrame([(c,) for c in ids], "fp long")
    cuts = Cuts(spark, "test")
    found = connected_components(simhash.index_links(items, 4, blocks, cuts, hot), cuts).collect()
    pairs = [(ids[b], ids[i]) for i in range(len(codes)) for b in np.flatnonzero(np.bitwise_count(codes[:i] ^ codes[i]) <= 4)]
    want = components(pairs, set(ids))
    linked = {n for p in pairs for n in p}
    assert {r["node"]: r["component"] for r in found} == {n: c for n, c in want.items() if n in linked}


def test_number_of_blocks():
    assert [simhash.blocks_for(n, 4) for n in (0, 1, 235_748, 14_000_000, 10**9, 10**11)] == [5, 5, 5, 6, 7, 8]


def test_rows_without_an_id_or_of_one_id_link_nothing_else(spark):
    """An id that several texts share, or that is missing, is no bridge between texts that are unlike."""
    r = random.Random(8)
    far = [" ".join(r.choices(WORDS, k=60)) for _ in range(6)]
    rows = [(8, far[0]), (3, far[0]), (9, far[1]), (3, far[1]), (None, far[2]), (None, far[3]), (5, far[4]), (None, far[5]), (7, far[5]), (None, far[2])]
    got = sorted(((x["doc_id"] or 0, x["component_id"]) for x in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    # texts 0 and 1 are two components, each named by its smallest id; texts 2 and 3 have no id at all
    assert got == sorted([(8, 3), (3, 3), (9, 3), (3, 3), (0, None), (0, None), (0, None), (5, 5), (0, 7), (7, 7)], key=str)
    one = [" ".join([*far[0].split(), "end"]), far[1], far[2]]
    got = simhash.near_duplicates(spark.createDataFrame([(4, far[0]), (None, one[1]), (None, one[2]), (6, far[3])], "doc_id long, text string")).collect()
    assert sorted((x["doc_id"] or 0, x["component_id"] or 0) for x in got) == [(0, 0), (0, 0), (4, 4), (6, 6)]


def test_shared_folder(spark):
    from gripeline.llm import shared

    cuts = Cuts(spark, "gone")
    path = cuts.cut(spark.range(3))._cut_path
    assert spark.read.parquet(path).count() == 3
    fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    Cuts.roots, kept = [cuts.root], Cuts.roots
    Cuts.clean(spark)
    Cuts.roots = kept
    assert not fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path))

    class Remote:
        master = "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Remote(), {}

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())

def test_runs_of_the_index():
    r = np.random.default_rng(2)
    codes = r.integers(1 << 12, size=3000, dtype=np.uint64)
    group = np.sort(r.integers(4, size=3000))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    got = {(int(a), int(b)) for x, y in simhash.linked_pairs(codes, starts, 2, 1 << 12) for a, b in zip(x, y, strict=True)}
    want = {(i, int(j)) for i in range(len(codes)) for j in np.flatnonzero((np.bitwise_count(codes[:i] ^ codes[i]) <= 2) & (group[:i] == group[i]))}
    assert got == want


@pytest.mark.parametrize(("crowd", "batch"), [(32, 4 << 20), (2, 2000)])
def test_similar_texts_against_brute_force(spark, monkeypatch, crowd, batch):
    """Links are the pairs of Jaccard similarity 0.8 or more, at the border and in crowds too, and no others."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    monkeypatch.setattr(simhash, "BATCH", batch)
    r = random.Random(9)
    sets = lambda t: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else set()
    rows = [(-i, t) for i, t in enumerate([None, "", "one", "One", "one two three four", "one two three four five"], 1)]
    shared = " ".join(r.choices(WORDS, k=20))
    for i in range(150):
        w = r.choices(WORDS, k=r.choice([12, 30, 60, 200]))
        t = w if i % 3 else [*w, *shared.split()]
        rows.append((i, " ".join(t)))
        u = list(t)
        for _ in range(max(1, round(len(u) * r.choice([0.005, 0.02, 0.025, 0.03]) + r.random() - 0.5))):
            u[r.randrange(len(u))] = "edit"
        rows.append((1000 + i, " ".join(u)))
        rows.append((2000 + i, " ".join(t[: len(t) - round(len(t) * r.choice([0.15, 0.19, 0.2, 0.21]))])))
    base = r.choices(WORDS, k=80)
    for i in range(90):  # many near copies of one text, not all of each other
        w = list(base)
        for _ in range(i % 4):
            w[r.randrange(80)] = f"e{r.randrange(3)}"
        rows.append((4000 + i, " ".join(w)))
    found = [(i, sets(t)) for i, t in rows]
    pairs = [(a, b) for n, (a, x) in enumerate(found) for b, y in found[:n] if x == y or 5 * len(x & y) >= 4 * len(x | y)]
    want = components(pairs, {i for i, _ in rows})
    assert 150 < len(set(want.values())) < len(rows) - 100
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == want and len(got) == len(rows)


def test_similar_texts_are_found_by_fingerprints(spark, monkeypatch):
    """With the prefix filter off, the index alone links near copies, by pairs within 4 bits that the exact check confirms."""
    monkeypatch.setattr(simhash, "_candidates", lambda *_: lambda batches: iter(()))
    r = random.Random(5)
    rows = []
    for i in range(12):
        w = r.choices(WORDS, k=600)
        rows += [(i, " ".join(w)), (100 + i, " ".join(["other", *w[1:]])), (200 + i, " ".join([*w[:-1], "end"]))]
    found = {i: np.unique(simhash.shingle_hashes(t, 5)) for i, t in rows}
    fp = {i: int(simhash._of_sets([h])[0]) for i, h in found.items()}
    near = [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4]
    assert len(near) > 20 and all(a % 100 == b % 100 for a, b in near)
    got = simhash.similar_texts(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["component_id"] for x in got} == components(near, set(fp))
    # within 4 bits, but not similar: the check rules it out
    monkeypatch.setattr(simhash, "_of_sets", lambda hashes: np.zeros(len(hashes), np.uint64))
    pairs = simhash.fingerprint_pairs(spark.createDataFrame([(1, 0), (2, 0), (3, 15), (4, 31), (5, -1)], "node long, fp long"), 4, Cuts(spark, "test"))
    assert sorted(map(tuple, pairs.collect())) == [(1, 2), (1, 3), (3, 4)]
    far = spark.createDataFrame([(1, "some words that stand here alone"), (2, "others of which none is shared at all")], "doc_id long, text string")
    assert {x["doc_id"]: x["component_id"] for x in simhash.similar_texts(far).collect()} == {1: 1, 2: 2}


def test_chain_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)] + [(200, 300 + i) for i in range(50)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, Cuts(spark, "test")).collect()}
    assert {got[i] for i in range(61)} == {0} and got[101] == 100 and {got[300 + i] for i in range(50)} == {200}


def test_units(spark):
    rows = texts(3, 30) + [(7000 + i, f"A shared line of text stands here.\nOwn {i} words, {i} of them. A sentence of more than six words repeats here. Tail {i}. Yes. No way.") for i in range(20)]
    rows += [(9000, "A b.\nA  B.\n\nc")] * 2
    for level in ("line", "paragraph"):
        d = spark.createDataFrame([(i, t, "mine", 1.5) for i, t in rows], "doc_id long, text string, kept_text string, lang double")
        got = sorted(units.remove_repeated_units(d, level).collect(), key=lambda r: (r["doc_id"], (r["text"] or "").encode()))
        want = plain.cut_units(rows, level)
        assert len(got) == len(rows)
        for r, (t, gone) in zip(got, want, strict=True):
            cut = {k for s in r["removed_spans"] for k in range(s["start"], s["end"])}
            assert (r["text"], r["lang"]) == (t, 1.5) and all(t[k].isspace() for k in cut ^ gone)
            if t is not None:
                assert "".join(c for k, c in enumerate(t) if k not in cut).replace("\n", "") == r["kept_text"].replace("\n", "")
    assert units.remove_repeated_units(d.limit(0)).count() == 0


def cut_repeats(rows, span):
    first, out = {}, []
    data = [(i, (t or "").encode()) for i, t in rows]
    for i, b in data:
        for s in range(len(b) - span + 1):
            first[b[s : s + span]] = min(first.get(b[s : s + span], i), i)
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - span + 1):
            if first[b[s : s + span]] < i:
                gone[s : s + span] = b"\1" * span
        edges = np.flatnonzero(np.diff(np.r_[0, np.frombuffer(bytes(gone), np.uint8).astype(int), 0])).reshape(-1, 2).tolist()
        out.append((i, [tuple(e) for e in edges], hashlib.sha256(bytes(x for x, y in zip(b, gone) if not y)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [4096, 0, 3])
def test_suffixes(spark, hot):
    r = random.Random(4)
    rows = [(i, " ".join(r.choices(WORDS[:50], k=60))) for i in range(40)]
    for i in range(40):
        a, b = r.choice(rows)[1], r.choice(rows)[1]
        x, n, y = r.randrange(len(a) // 2), r.choice([20, 49, 50, 51, 75, 120]), r.randrange(len(b))
        rows.append((r.randrange(-50, 2000), b[:y] + a[x : x + n] + b[y:]))
    rows += [(-900, None), (-901, ""), (3000, "a" * 300), (3001, "a" * 120), (3002, "a" * 50), (3002, "a" * 50), (3003, "b" * 49), (3004, "é" * 40), (3005, "xé" + "é" * 30)]
    d = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, spans string")
    got = sorted((x["doc_id"], [(s["start"], s["end"]) for s in x["spans"]], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in suffixes.remove_repeats(d, hot=hot).collect())
    assert got == cut_repeats(rows, 50)
    assert suffixes.remove_repeats(d.limit(0)).count() == 0


@pytest.mark.parametrize("span", [50, 200, 256, 257, 400, 700, 701])
def test_long_spans(spark, span):
    """A shared run of 700 bytes goes whole for every span up to its length."""
    r = random.Random(6)
    shared = "".join(r.choices("abcdefghij klmnop", k=700))
    rows = [(1, "xy" + shared + "tail"), (2, "qq" + shared + "zz"), (3, shared[100:600]), (None, shared[:300])]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((x["doc_id"] or 0, [(s["start"], s["end"]) for s in x["spans"]], hashlib.sha256(bytes(x["kept"])).hexdigest()) for x in suffixes.remove_repeats(d, span=span).collect())
    assert got == cut_repeats([(i or 0, t) for i, t in rows], span)
    if span in (400, 700):
        assert got[2][1] == [(2, 702)]


def test_short_span(spark):
    with pytest.raises(ValueError, match="anchor"):
        suffixes.remove_repeats(spark.createDataFrame([(1, "x")], "doc_id long, text string"), span=20)


def test_radix_groups():
    r = np.random.default_rng(0)
    data = r.integers(2, size=4000).astype(np.uint8)
    at = np.arange(3900)
    group = suffixes.radix_groups(data, at, 10)
    by = {}
    for i in at:
        by.setdefault(data[i : i + 10].tobytes(), []).append(i)
    for same in by.values():
        assert len({group[i] for i in same}) == 1 and (group[same[0]] >= 0) == (len(same) > 1)
    assert len(set(group[group >= 0])) == sum(len(s) > 1 for s in by.values())


def test_long_texts_cross_segments(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SEGMENT", 64)
    data = [("ab cd ef gh " * 30 + "tail").encode(), ("xx" + "ab cd ef gh " * 10).encode(), b"", b"q" * 200]
    d, first, length, anchor, key, text = suffixes.runs(data, 50, 28)
    covered = sorted((int(t), int(f + k)) for f, n, t in zip(first, length, text, strict=True) for k in range(n))
    ends = np.cumsum([len(x) for x in data])
    want = sorted((i, s) for i, x in enumerate(data) for s in range(ends[i] - len(x), ends[i] - 49))
    assert covered == want
    seen = {}
    for f, n, a, k in zip(first, length, anchor, key, strict=True):
        for j in range(n):
            w = d[f + j : f + j + 50].tobytes()
            assert seen.setdefault(w, (int(a - f - j), int(k))) == (int(a - f - j), int(k))


def test_null_ids(spark):
    from gripeline.llm import bpe, decontamination, language, licences, lm, quality

    passage = "a passage that is long enough to count as fifty bytes and more of it"
    rows = [(None, passage, "x"), (None, None, "y"), (1, passage, "z"), (2, passage + " with an end", None), (None, "other words here", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, path string")
    near = simhash.near_duplicates(d).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"])) for r in near) == sorted([("None", "1"), ("None", "None"), ("1", "1"), ("2", "2"), ("None", "None")])
    assert sum(r["doc_id"] is None for r in suffixes.remove_repeats(d).collect()) == 3
    kept = {(r["doc_id"], r["text"]): r["kept_text"] for r in units.remove_repeated_units(d).collect()}
    assert kept[(None, passage)] == passage and kept[(1, passage)] == "" and len(kept) == 5
    assert lm.stupid_backoff(d).count() == 5 and bpe.encode(d).count() == 5 and quality.judge(d).count() == 5 and licences.scan(d).count() == 5
    assert language.predict(d, language.fit(d.limit(0).withColumn("lang", d["path"]))).count() == 5
    items = spark.createDataFrame([(None, passage), (3, passage)], "item_id long, text string")
    assert decontamination.contained_items(d, items).count() == 6
