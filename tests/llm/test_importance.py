"""Importance resampling against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from gripeline.llm import importance

SPLIT = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def plain_features(text):
    w = SPLIT.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1)], len(w)


def plain(rows, target, n_buckets, percent, min_words, seed):
    found = [plain_features(t) for _, t in rows]
    of = lambda fs: [zlib.crc32(x.encode()) % n_buckets for x in fs]
    s, t = Counter(b for fs, _ in found for b in of(fs)), Counter(b for x in target for b in of(plain_features(x)[0]))
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + n_buckets) / ((s[b] + 1) * (t_all + n_buckets))))
    out = []
    for (i, _), (fs, n) in zip(rows, found):
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, of(fs)))
        out.append((i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    good = sorted((x for x in out if x[4] >= min_words), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    ranks = Counter((x[:4], k + 1) for k, x in enumerate(good[: percent * len(good) // 100]))
    drawn = Counter(x for x, _ in ranks.elements())
    return sorted([(str(x), k) for x, k in ranks.elements()] + [(str(x), None) for x in (Counter(x[:4] for x in out) - drawn).elements()], key=str)


ROWS = [(i, " ".join(f"w{(i * 7 + k * k) % 23}" for k in range(5 + i % 40)) + (" bench mark item" if i % 9 == 0 else "")) for i in range(200)]
ROWS += [(300, None), (301, ""), (302, "\t--\x7f{}"), (303, "Ünïcode TEXT, 漢字! É2 a1B"), (None, "no id at all here " * 10), (None, "no id at all here " * 10), (304, "the"), (5, ROWS[5][1])]
ROWS += [(i, "copy of one text that is long enough to be drawn with all of its words and some more words to come") for i in range(400, 460)]
TARGET = ["bench mark item", "the mark", None, "", "Bench, MARK w3 w4"]


@pytest.mark.parametrize(("n_buckets", "percent"), [(10_000, 5), (7, 60), (70_000, 100)])
def test_resample(spark, n_buckets, percent, monkeypatch):
    monkeypatch.setattr(importance, "BLOCK_DOCS", 16)
    d = spark.createDataFrame([(i, t, 1) for i, t in ROWS], "doc_id long, text string, rank int").repartition(5)
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    got = importance.resample(d, target, n_buckets=n_buckets, percent=percent).collect()
    found = sorted(((str((r["doc_id"], r["n_features"], r["weight"], r["score"])), r["rank"]) for r in got), key=str)
    assert found == plain(ROWS, TARGET, n_buckets, percent, 20, 42)
    assert [r["rank"] for r in sorted(got, key=lambda r: r["rank"] or 10**9) if r["rank"]] == list(range(1, 1 + sum(r["rank"] is not None for r in got)))


def test_empty_and_drawn(spark):
    d = spark.createDataFrame(ROWS, "doc_id long, text string")
    target = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert importance.resample(d.limit(0), target).count() == 0
    some = importance.resample(d, target.limit(0)).collect()
    assert sorted(((str((r["doc_id"], r["n_features"], r["weight"], r["score"])), r["rank"]) for r in some), key=str) == plain(ROWS, [], 10_000, 5, 20, 42)
    ranked = {r["doc_id"] for r in importance.resample(d, target, percent=30).collect() if r["rank"]}
    rows = importance.drawn(d, target, percent=30).collect()
    assert {r["doc_id"] for r in rows} == ranked and rows[0].asDict().keys() == {"doc_id", "text"}


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"Wort{i % 97}" for i in range(3000)) + "x" * 400 + " --  z" * 50
    whole = sorted(importance.features(text.encode(), 10_000)[0].tolist())
    fs, n = plain_features(text)
    assert whole == sorted(zlib.crc32(x.encode()) % 10_000 for x in fs)
    for piece in (1, 2, 7, 100, 5000):
        monkeypatch.setattr(importance, "PIECE", piece)
        got = importance.features(text.encode(), 10_000)
        assert sorted(got[0].tolist()) == whole and got[1] == n
