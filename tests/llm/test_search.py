"""Licences, languages, decontamination, scores and the pipeline."""

import math
import random
from collections import Counter

import corpus_pipeline
import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from gripeline.llm import bpe, decontamination, language, licences, lm
from gripeline.llm.shared import Cuts

DIR = "/root/testdata/sf0.001"


APACHE = """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0"""
MIT = """MIT License

Copyright (c) 2020 Some Body

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""
GPL = """ * This program is free software; you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation; either version 3 of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
BSD = """// Redistribution and use in source and binary forms, with or without
// modification, are permitted provided that the following conditions are
// met:
// 1. Redistributions of source code must retain the above copyright notice,
// this list of conditions and the following disclaimer."""
CODE = "\n".join(f"def step_{i}(value, other):\n    return value * {i} + other.field_{i}" for i in range(30))


def test_licences(spark):
    rows = [
        ("a/LICENSE", MIT), ("a/b/c/x.py", CODE), ("a/b/COPYING.txt", GPL), ("a/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        ("a/z.py", None), ("z/q.py", ""), (None, "All rights reserved."), ("top.py", "We licensed a song and wrote about it at length in many other words than those of any template"), ("a/b/c/x.py", CODE),
        ("h/asf.py", APACHE + "\n" + CODE), ("h/gpl.c", CODE + "\n" + GPL + "\n" + CODE), ("h/bsd.cc", BSD + "\n\n" + CODE), ("h/spdx.py", "# SPDX-License-Identifier: MIT\n" + CODE), ("h/spdx2.py", "// SPDX-License-Identifier: Apache-2.0"),
        ("m/notes.txt", MIT), ("m/deep/er/x.py", CODE), ("h/none.py", CODE),
    ]
    d = spark.createDataFrame([(None if i in (0, 15) else i % 12, i, p, t, "old") for i, (p, t) in enumerate(rows)], "doc_id long, n int, path string, text string, licence string")
    got = {r["n"]: (r["licence"], r["origin"], r["from_dir"]) for r in licences.scan(d).collect()}
    assert got.pop(11) in {("BSD-2-Clause", "own", None), ("BSD-3-Clause", "own", None)}  # what both begin with
    assert got == {
        0: ("MIT", "own", None), 1: ("GPL-3.0", "inherited", "a/b"), 2: ("GPL-3.0", "own", None), 3: ("Apache-2.0", "own", None), 4: ("MIT", "inherited", "a"), 5: (None, None, None),
        6: ("Proprietary", "own", None), 7: (None, None, None), 8: ("GPL-3.0", "inherited", "a/b"), 9: ("Apache-2.0", "own", None), 10: ("GPL-3.0", "own", None),
        12: ("MIT", "own", None), 13: ("Apache-2.0", "own", None), 14: ("MIT", "own", None), 15: ("MIT", "inherited", "m"), 16: ("Apache-2.0", "inherited", "h"),
    }
    assert licences.scan(d.limit(0)).count() == 0 and licences.scan(d.withColumn("text", F.lit(None).cast("string"))).where("licence is not null").count() == 0


def test_licence_windows_against_brute_force(spark):
    """Every window of every text against every template, by plain sums; nothing is ruled out beforehand."""
    r = random.Random(7)
    bits = [*MIT.split("\n"), *GPL.split("\n"), *APACHE.split("\n"), *CODE.split("\n")[:20], "", "  ", "word " * 30, "Released under the MIT License.", "© ünïcode text"]
    texts = ["\n".join(r.choices(bits, k=r.choice([1, 2, 5, 14, 40]))) for _ in range(25)] + [MIT, GPL, MIT + "\n" + CODE + "\n" + GPL]
    idf, (found, unknown) = licences.idfs(), licences.vectors()
    of = {}
    for t, name, w, x in found:
        of.setdefault((t, name), {})[w] = x
    got = {x["doc_id"]: x for x in licences.own_licences(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        lines = [w for x in text.split("\n") if (w := licences.words_of(x))]
        spans = [(a, a + n) for n, step in licences.WINDOWS.items() for a in range(0, len(lines) - n + 1, step)] + [(0, len(lines))] * bool(lines)
        hits, covered = [], set()
        for a, z in spans:
            c = Counter(w for x in lines[a:z] for w in x)
            v = {w: n * idf.get(w, unknown) for w, n in c.items()}
            norm = math.sqrt(sum(x * x for x in v.values()))
            cos, t, name = max((round(sum(v[w] * x for w, x in ws.items() if w in v) / norm, 6), -t, name) for (t, name), ws in of.items())
            if cos >= licences.THRESHOLD:
                hits.append((-cos, z - a, a, -t, name))
                covered |= set(range(a, z))
        best = min(hits) if hits else (None, 0, 0, 0, None)
        assert got[i]["licence"] == best[4] and (best[0] is None or got[i]["similarity"] == pytest.approx(-best[0], abs=2e-6)), text
        if hits:
            assert got[i]["share"] == pytest.approx(sum(len(lines[k]) for k in covered) / sum(map(len, lines)))


def test_language(spark):
    rows = [("the house and the garden", "en"), ("das haus und der garten", "de"), (None, "en"), ("la maison et le jardin", "fr"), ("x", None)]
    model = language.fit(spark.createDataFrame(rows * 3, "text string, lang string"))
    d = spark.createDataFrame([(1, "the garden"), (2, "und das"), (3, "jardins!"), (4, None), (5, "12 !?"), (6, ""), (7, "The " * 5000)], "doc_id long, text string").withColumn("score", F.lit("old"))
    got = {r["doc_id"]: r for r in language.predict(d, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 8)] == ["en", "de", "fr", "und", "und", "und", "en"]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[4]["score"] == 0
    assert language.predict(d.limit(0), model).count() == 0
    none = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert {r["lang_pred"] for r in language.predict(d, none).collect()} == {"und"}


def test_language_against_brute_force(spark):
    """The whole method again in plain Python: sample, counts, words first, then n-grams from long to short."""
    import numpy as np
    import regex

    r = random.Random(4)
    sounds = {"aa": "abcde", "bb": "cdefg", "cc": "xyzéß"}
    say = lambda lang, n: " ".join("".join(r.choices(sounds[lang], k=r.randint(1, 5))) for _ in range(n))
    labelled = [(say(x, 8), x) for x in sounds for _ in range(12)] + [("Shared, WORDS 12 shared", "bb"), (None, "aa"), ("not told", None)]
    labelled += [labelled[0]] * 9  # copies teach no more than one
    text = spark.createDataFrame(labelled, "text string, lang string")
    asked = [say(x, 5) + " " + w for x in sounds for w in ("", "abx", "qqq", "shared Words", "ÉÉ 3 é")] + ["qq ww", "1 2"]
    got = {x["text"]: (x["lang_pred"], x["score"]) for x in language.predict(spark.createDataFrame([(t,) for t in asked], "text string"), language.fit(text)).collect()}
    letters = lambda t: regex.findall(r"\p{L}+", t.lower())
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    counts = {x: [Counter(), *(Counter() for _ in range(4))] for x in sounds}
    for t, x in {(t, x) for t, x in labelled if t is not None and x is not None}:
        for w in letters(t):
            counts[x][0][w] += 1
            for n in range(1, 5):
                counts[x][n].update(grams(w, n))
    size = lambda x, n: max(sum(counts[x][n].values()), 1)
    log = lambda x, n, g: math.log(counts[x][n][g] / size(x, n) if counts[x][n][g] else 0.5 / max(size(y, n) for y in sounds))
    for t in asked:
        total = dict.fromkeys(sounds, 0.0)
        for w in letters(t):
            for n, parts in [(0, [w]), *((n, grams(w, n)) for n in (4, 3, 2, 1)), (None, [])]:
                steps = 0 if n == 0 else 4 if n is None else 5 - n
                known = [g for g in parts if any(counts[x][n][g] for x in sounds)]
                if known or n is None:
                    for x in sounds:
                        total[x] += (np.mean([log(x, n, g) for g in known]) + steps * math.log(0.4)) if known else (steps + 1) * math.log(0.4)
                    break
        if not letters(t):
            assert got[t] == ("und", 0.0)
            continue
        mean = {x: total[x] / len(letters(t)) for x in sounds}
        best = max(sorted(mean), key=lambda x: mean[x])
        ties = [x for x in mean if abs(mean[x] - mean[best]) < 1e-5]
        assert got[t][0] in ties and got[t][1] == pytest.approx(1 / sum(math.exp(mean[x] - mean[best]) for x in mean), rel=1e-4)


def test_language_sample(spark):
    """The bound counts different texts; copies are one, and a language of few texts keeps them all."""
    rows = [(f"text {i}", "aa") for i in range(200)] + [("same", "aa")] * 500 + [("few", "bb"), ("few", "bb"), ("some", "bb")]
    got = language.sample(spark.createDataFrame(rows, "text string, lang string"), language.Settings(docs_per_language=30)).collect()
    by = Counter(r["lang"] for r in got)
    assert len(set(got)) == len(got) and by["bb"] == 2 and 10 <= by["aa"] <= 30
    assert language.sample(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_language_held_out(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    r = language.predict(docs.where(held), language.fit(docs.where(~held)), keep_text=False).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert r >= 0.95


def shingles(t):
    w = (t or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


@pytest.mark.parametrize("rows", [1_000_000, 0])
def test_decontamination(spark, rows):
    r = random.Random(1)
    words = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(r.choices(words, k=r.choice([1, 3, 5, 6, 12, 40])))) for i in range(30)] + [(100, None), (101, ""), (0, None)]
    docs = []
    for i in range(60):
        t = (r.choice(items)[1] or "").split()
        if t and i % 2:
            t[r.randrange(len(t))] = "edit"
        docs.append((i, " ".join(r.choices(words, k=r.choice([0, 50]))) + " " + " ".join(t) + " x" * (i % 3)))
    docs += [(900, None), (901, ""), (5, docs[5][1])] + [(i + 1000, t) for i, t in items[:5]]
    got = decontamination.contained_items(spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame(items, "item_id long, text string"), broadcast_rows=rows).collect()
    want = {}
    for d, t in docs:
        for i, x in items:
            if (s := shingles(x)) and (n := len(s & shingles(t))) >= 0.8 * len(s):
                want[(d, i)] = (n, len(s))
    assert {(g["doc_id"], g["item_id"]): (g["n_shared"], g["n_item"]) for g in got} == want and want


def test_decontamination_without_ids(spark):
    """Documents without an id are told apart by their texts; half a passage in each of two is no whole one."""
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(1, " ".join(words)), (2, "b1 b2 b3 b4 b5 b6 b7")], "item_id long, text string")
    half = [(None, " ".join(words[:22])), (None, " ".join(words[18:]))]
    whole = [(None, "x " + " ".join(words)), (None, "x " + " ".join(words)), (None, " ".join(words) + " y"), (7, " ".join(words[:22])), (7, " ".join(words[18:])), (8, None), (None, None), (9, "")]
    docs = spark.createDataFrame(half + whole, "doc_id long, text string")
    got = decontamination.contained_items(docs, items).collect()
    assert sorted((str(r["doc_id"]), r["item_id"], round(r["containment"], 6)) for r in got) == [("7", 1, 1.0), ("None", 1, 1.0), ("None", 1, 1.0)]
    assert decontamination.contained_items(docs.limit(0), items).count() == 0 and decontamination.contained_items(docs, items.limit(0)).count() == 0


def test_search_meets_sketches_only(spark):
    """What shares shingles with an item, but none of its sketch, is never a candidate and so never compared."""
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    every = decontamination.sketches(items, 0.8, 5, "item_id", "text").collect()
    d = spark.createDataFrame([(i, " ".join(words[i : i + 5])) for i in range(56)], "doc_id long, text string")
    of = {r["doc_id"]: (r["h"], r["g"]) for r in decontamination._shingles(d, "text", 5).collect()}
    sketch = {(r["h"], r["g"]) for r in every if r["in_sketch"]}
    assert 0 < len(sketch) < len(every) / 2
    rows = d.selectExpr("doc_id", "0L row", "text")
    found = decontamination.candidates(rows, spark.createDataFrame(every).where("in_sketch").select("item_id", "h", "g"), 5).collect()
    assert {r["doc_id"] for r in found} == {i for i, s in of.items() if s in sketch}


def test_stupid_backoff(spark):
    r = random.Random(2)
    words = ["a", "B", "c", "d", "e"]
    rows = [(i, " ".join(r.choices(words, k=r.randint(0, 12)))) for i in range(40)] + [(50, None), (51, ""), (52, "once"), (52, "once"), (53, "A b\tC\n d")]
    docs = [(i, (t or "").lower().split()) for i, t in rows]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total = sum((grams(w) for _, w in docs), Counter())
    n = sum(len(w) for _, w in docs)
    want = []
    for i, w in docs:
        own = grams(w)
        c = lambda *g: total[g] - own[g]  # noqa: B023, E731
        s = 0.0
        for k, x in enumerate(w):
            p = max(c(x), 1) / max(n - len(w), 1)
            if k >= 1:
                p = c(w[k - 1], x) / c(w[k - 1]) if c(w[k - 1], x) > 0 else 0.4 * p
            if k >= 2:
                p = c(w[k - 2], w[k - 1], x) / c(w[k - 2], w[k - 1]) if c(w[k - 2], w[k - 1], x) > 0 else 0.4 * p
            s += math.log(p)
        want.append((i, len(w), round(s, 8)))
    d = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, n_words int")
    got = lm.stupid_backoff(d).collect()
    assert sorted((g["doc_id"], g["n_words"], round(g["log_score"], 8)) for g in got) == sorted(want)
    assert {g["mean_log_score"] for g in got if not g["n_words"]} == {None} and lm.stupid_backoff(d.limit(0)).count() == 0


def test_pipeline(spark):
    """Stage by stage and as a whole, against plain Python and the tokenizers library."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    odd = [(-1, None), (-2, ""), (None, "word " * 60), (None, None), (5, "A second text of id five. " + " ".join(f"f{i}" for i in range(60)) + ".")]
    docs = docs.unionByName(spark.createDataFrame([(i, t, "en", "x", 1, "more") for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long, extra string").select(*docs.columns))
    docs = docs.unionByName(docs.orderBy("doc_id").limit(3)).cache()
    rows = lambda df: sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    same = lambda df, want: rows(df) == sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    cuts = Cuts(spark, "test")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "repeated_passages", "benchmark_leaks", "tokens"]

    one = cuts.cut(corpus_pipeline.quality_rules(spark, docs, DIR))
    want = [(i, t) for i, x in rows(docs) if (t := plain.clean(x)) is not None]
    assert one.columns == docs.columns and same(one, want) and 50 < len(want) < docs.count()

    two = cuts.cut(corpus_pipeline.near_duplicates(spark, one, DIR))
    want = plain.first_of_similar(want)
    assert two.columns == docs.columns and same(two, want) and len(want) < one.count()

    three = cuts.cut(corpus_pipeline.repeated_passages(spark, two, DIR))
    by_id = sorted(want, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    left = {(i, "".join(c for k, c in enumerate(t) if k not in gone).replace("\n", "")) for (i, _), (t, gone) in zip(by_id, plain.cut_units(want), strict=True)}
    assert {(i, t.replace("\n", "")) for i, t in rows(three)} == {(i, t) for i, t in left if t.strip()}

    four = cuts.cut(corpus_pipeline.benchmark_leaks(spark, three, DIR))
    items = [s for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() if (s := plain.shingles(r["text"]))]
    assert same(four, [(i, t) for i, t in rows(three) if not any(len(s & plain.shingles(t)) >= 0.8 * len(s) for s in items)])

    five = {(r["doc_id"]): r for r in corpus_pipeline.tokens(spark, four, DIR).collect()}
    t = Tokenizer.from_file(bpe.default_path())
    text = dict(rows(four))
    assert set(five) == set(text)
    for i, r in five.items():
        ids = t.encode(text[i], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), np.uint32).tolist() == ids and r["round_trip"] and r["n_tokens"] == len(ids)

    docs = cuts.cut(spark.read.parquet(f"{DIR}/documents.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        docs = cuts.cut(stage(spark, docs, DIR))
    key = lambda df: sorted((r["doc_id"], bytes(r["ids"])) for r in df.collect())
    assert key(corpus_pipeline.run(spark, DIR)) == key(docs)


def test_pipeline_null_and_equal_ids(spark):
    """Rows without an id or of equal ids are judged by their own texts in each stage."""
    r = random.Random(3)
    make = lambda n=60: " ".join("".join(r.choices("abcdefghij", k=6)) for _ in range(n)) + "."
    a, b, c, d, e, f = (make() for _ in range(6))
    leak = max((x["text"] for x in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() if x["text"]), key=len)
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    run = lambda stage, rows: sorted([(x["doc_id"], x["text"]) for x in stage(spark, frame(rows), DIR).collect()], key=key)
    rows = [(None, a), (None, b), (7, c), (7, d), (None, e), (3, e + " x"), (None, f), (None, f), (9, c)]
    assert run(corpus_pipeline.quality_rules, rows) == sorted(rows, key=key)
    assert run(corpus_pipeline.near_duplicates, rows) == sorted([(None, a), (None, b), (7, c), (7, d), (3, e + " x"), (None, f)], key=key)
    rows = [(None, a), (None, leak), (7, b), (7, leak), (8, leak), (9, c)]
    assert run(corpus_pipeline.benchmark_leaks, rows) == sorted([(None, a), (7, b), (9, c)], key=key)
    rows = [(None, a), (None, b), (7, c), (7, d)]
    assert run(corpus_pipeline.repeated_passages, rows) == sorted(rows, key=key)
    assert len(corpus_pipeline.tokens(spark, frame(rows), DIR).collect()) == 4


def test_pipeline_on_nothing(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DIR)
        assert out.count() == 0


def test_very_long_text(spark):
    """A text of 1.5 MB goes through every operator whole: what stands at its end counts."""
    from test_dedup import fingerprint
    from test_formats import counts

    from gripeline.llm import quality, simhash, suffixes, units

    r = random.Random(12)
    made = ["".join(r.choices("abcdefghijklmnop", k=r.randint(2, 8))) for _ in range(40_000)]
    lines = [" ".join(r.choices(made, k=12)) + "." for _ in range(21_000)]
    item = " ".join(f"item{i}" for i in range(30))
    end = "A closing line which another document has already said, in these words."
    text = "\n".join([*lines, "Released under the MIT License.", item, end])
    assert len(text) > 1_400_000
    d = spark.createDataFrame([(2, text, "x/y"), (1, end, "x/z")], "doc_id long, text string, path string")
    of = lambda df: {x["doc_id"]: x for x in df.collect()}
    assert of(simhash.near_duplicates(d))[2]["fp"] % (1 << 64) == fingerprint(text, 4)
    q = of(quality.judge(d))[2]
    assert (q["n_words"], q["word_chars"], q["n_symbols"], q["n_dup_lines"], q["n_repeat_words"]) == counts(text) and q["kept"]
    assert of(units.remove_repeated_units(d))[2]["removed_spans"][-1].asDict() == {"start": len(text) - len(end), "end": len(text)}
    spans = of(suffixes.remove_repeats(d))[2]["spans"]
    assert [(x["start"], x["end"]) for x in spans] == [(len(text) - len(end), len(text))]
    assert of(licences.own_licences(d))[2]["licence"] == "MIT"
    assert of(decontamination.contained_items(d, spark.createDataFrame([(7, item)], "item_id long, text string")))[2]["item_id"] == 7
    model = language.fit(spark.createDataFrame([(text[:9000], "aa"), ("xyz zzz", "bb")], "text string, lang string"))
    assert of(language.predict(d, model))[2]["lang_pred"] == "aa"
    assert of(lm.stupid_backoff(d))[2]["n_words"] == len(text.split())
    done = of(bpe.decode(bpe.encode(d)))[2]
    assert done["decoded_text"] == text and done["n_tokens"] > 300_000
