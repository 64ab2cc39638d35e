"""Neighbours and density clusters against plain Python."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gripeline.folders import Tables
from gripeline.operators import density, neighbours


def plain_near(points, k):
    out = {}
    for i, x in points:
        out[i] = sorted((math.sqrt(sum((p - q) ** 2 for p, q in zip(x, y))), j) for j, y in points if j != i)[:k]
    return out


def linked(spark, points):
    """The links between cells that the library makes, checked by themselves: true lengths, and they join all distinct vectors."""
    base = neighbours.usable(frame(spark, points)).groupBy("vec").agg(F.min("id").alias("id")).select("id", "vec")
    found = [(r["d"], r["a"], r["b"]) for r in density.links(base, neighbours.Cells(base), Tables(spark, "t")).collect()]
    x = {r["id"]: r["vec"] for r in base.collect()}
    part = {i: i for i in x}
    for d, a, b in found:
        assert a < b and d == pytest.approx(math.sqrt(sum((p - q) ** 2 for p, q in zip(x[a], x[b]))))
        old, new = part[a], part[b]
        part = {i: new if p == old else p for i, p in part.items()}
    assert len(set(part.values())) == 1 and len(found) == len(x) - 1
    return found


def plain_clusters(points, least, samples, neighbours_, more):
    """Kruskal over the neighbour graph and ``more`` edges, then the condensed tree from the root down; sides of a split, stabilities and the choice by recursion."""
    reps, of = {}, {}
    for i, x in sorted(points):
        of[i] = reps.setdefault(tuple(x), i)
    m = {r: sum(o == r for o in of.values()) for r in reps.values()}
    near = plain_near([(r, x) for x, r in reps.items()], max(neighbours_, samples))
    core = {}
    for r in m:
        n, core[r] = m[r] - 1, 0.0 if m[r] > samples else None
        for d, j in near[r]:
            n += m[j]
            if core[r] is None and n >= samples:
                core[r] = d
        if core[r] is None:
            core[r] = near[r][-1][0] if near[r] else 0.0
    length = {(min(r, j), max(r, j)): d for r in m for d, j in near[r]}
    for d, a, b in more:
        length[a, b] = min(d, length.get((a, b), d))
    edges = sorted((max(d, core[a], core[b], density.CLOSEST), a, b) for (a, b), d in length.items())
    tree = {r: ("leaf", r, max(core[r], density.CLOSEST), m[r], None, None) for r in m}
    find = {r: r for r in m}

    def root(x):
        while find[x] != x:
            x = find[x]
        return x

    for w, a, b in edges:
        a, b = root(a), root(b)
        if a != b:
            tree[a] = ("edge", None, w, tree[a][3] + tree[b][3], tree[a], tree[b])
            find[b] = a
    tops = [tree[r] for r in m if root(r) == r and tree[r][3] >= least]

    def leaves(t):
        stack, out = [t], []
        while stack:
            t = stack.pop()
            out += [(t[1], t[3])] if t[0] == "leaf" else []
            stack += [x for x in t[4:] if x]
        return out

    def cluster(t, birth, selectable):
        """(value, chosen) of the cluster that begins at t; chosen is a list of lists of points."""
        total, below, picks, mine = 0.0, 0.0, [], leaves(t)
        while True:
            if t[0] == "leaf":
                total += t[3] * (1 / t[2] - birth)
                break
            big = [x for x in t[4:] if x[3] >= least]
            here = 1 / t[2]
            if len(big) == 2:
                total += t[3] * (here - birth)
                for x in big:
                    value, got = cluster(x, here, True)
                    below, picks = below + value, picks + got
                break
            total += (t[3] - (big[0][3] if big else 0)) * (here - birth)
            if not big:
                break
            t = big[0]
        return (total, [mine]) if selectable and total >= below * (1 - 1e-9) else (below, picks)

    label = {}
    for t in tops:
        for group in cluster(t, 0.0, len(tops) > 1)[1]:
            for r, _ in group:
                label[r] = min(x for x, _ in group)
    return {i: label.get(r, -1) for i, r in of.items()}


def blobs(seed, n, dims, spread, around=6):
    rng = random.Random(seed)
    centres = [[rng.randrange(-60, 60) for _ in range(dims)] for _ in range(around)]
    return [(i, [float(c + round(rng.gauss(0, spread))) for c in rng.choice(centres)]) if i % 9 else (i, [float(rng.randrange(-90, 90)) for _ in range(dims)]) for i in range(n)]


def frame(spark, points):
    return spark.createDataFrame([(i, x, "o") for i, x in points], "id long, embedding array<float>, cluster string").repartition(3)


def test_exact_neighbours(spark):
    points = blobs(1, 240, 3, 4) + [(1000 + i, [5.0, 5.0, 5.0]) for i in range(30)]
    base = neighbours.usable(frame(spark, points))
    got = {r["id"]: [(n["d"], n["near"]) for n in r["near"]] for r in neighbours.nearest(base, base, 6, Tables(spark, "t"), probes=1, exact=True, same=True).collect()}
    assert got == plain_near(points, 6)
    few = neighbours.nearest(base.where("id < 4"), base.where("id in (7, 9)"), 6, Tables(spark, "t"), exact=True).collect()
    assert {r["id"]: len(r["near"]) for r in few} == {i: 2 for i in range(4)}
    assert neighbours.nearest(base, base.limit(0), 3, Tables(spark, "t")).count() == 0


def test_recall_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(20, 32))
    points = [(i, (centres[i % 20] + 0.4 * rng.normal(size=32)).astype(np.float32).tolist()) for i in range(800)]
    base = neighbours.usable(frame(spark, points))
    got = {r["id"]: {n["near"] for n in r["near"]} for r in neighbours.nearest(base, base, 10, Tables(spark, "t"), probes=8, same=True).collect()}
    want = plain_near(points[:200], 0) and {i: {j for _, j in sorted((sum((p - q) ** 2 for p, q in zip(x, y)), j) for j, y in points if j != i)[:10]} for i, x in points[:60]}
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * 10 * len(want)


@pytest.mark.parametrize(("seed", "dims", "spread", "least", "samples"), [(1, 2, 3, 5, None), (2, 3, 2, 4, 2), (3, 1, 9, 8, 3)])
def test_clusters(spark, seed, dims, spread, least, samples):
    points = blobs(seed, 130, dims, spread) + [(500 + i, [7.0] * dims) for i in range(9)] + [(600 + i, [-500.0 - 200 * i] * dims) for i in range(3)]
    got = density.clusters(frame(spark, points), min_cluster_size=least, min_samples=samples, neighbours=6, exact=True).collect()
    assert {r["id"]: r["cluster"] for r in got} == plain_clusters(points, least, least if samples is None else samples, 6, linked(spark, points))
    assert len({r["cluster"] for r in got}) > 2 and any(r["cluster"] == -1 for r in got)


def test_clusters_of_odd_rows(spark):
    odd = [(None, [1.0]), (1, None), (2, []), (3, [math.nan]), (4, [None]), (5, [math.inf]), (6, [1.0, 2.0])]
    assert density.clusters(frame(spark, odd[:-1])).count() == 0 and density.clusters(frame(spark, odd).limit(0)).count() == 0
    same = [(i, [1.0, 2.0]) for i in range(12)]
    assert {r["cluster"] for r in density.clusters(frame(spark, same), exact=True).collect()} == {-1}  # one part: the root is no cluster
    two = same + [(100 + i, [900.0 + i, 2.0]) for i in range(20)]
    got = {r["id"]: r["cluster"] for r in density.clusters(frame(spark, two), neighbours=5, exact=True).collect()}
    assert got == plain_clusters(two, 5, 5, 5, linked(spark, two)) and got[3] == 0


def plain_choice(rows):
    """{cluster: label} by recursion from the leaves up; rows (cluster, above, stability, selectable)."""
    kids, of, own, value = {}, {r[0]: r for r in rows}, {}, {}
    for c, up, _, _ in rows:
        kids.setdefault(up, []).append(c)
    order = [c for c in kids[None]]
    for c in order:
        order += kids.get(c, [])
    for c in reversed(order):
        below = sum(value[k] for k in kids.get(c, []))
        own[c] = of[c][3] and of[c][2] >= below * (1 - 1e-9)
        value[c] = of[c][2] if own[c] else below
    label = {None: None}
    for c in order:
        label[c] = label[of[c][1]] if label[of[c][1]] is not None else c if own[c] else None
    return {c: x for c, x in label.items() if x is not None}


def deep_tree(seed, n, back):
    """A root and splits in two, each of one of the last ``back`` clusters; stabilities fall down the tree, so that choices are mixed."""
    rng = random.Random(seed)
    rows, free, at = [(0, None, 1.0, False)], [(0, 64.0)], 0
    while at < n:
        c, s = free.pop(rng.randrange(max(0, len(free) - back), len(free)))
        for _ in range(2):
            at += 1
            free.append((at, s * rng.choice((0.3, 0.45, 0.5, 0.9))))
            rows.append((at, c, rng.choice((0.0, free[-1][1], 3 * rng.random())), True))
    return rows


@pytest.mark.parametrize(("seed", "n", "back"), [(1, 240, 1), (2, 240, 2), (3, 240, 200), (4, 2, 1)])
def test_choice_takes_few_rounds(spark, seed, n, back):
    rows, tables = deep_tree(seed, n, back), Tables(spark, "t")
    got = density.chosen(spark.createDataFrame(rows, "cluster long, above long, stability double, selectable boolean"), tables)
    assert {r["cluster"]: r["label"] for r in got.collect()} == plain_choice(rows)
    assert tables.n <= 4 * math.log2(n) + 8  # a round a level would be two tables for each of 120 levels
