"""Chat formatting, BPE and quality rules against plain Python."""

import hashlib
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from gripeline.llm import bpe, chat, quality

TURNS = [
    (1, 0, "user", "hi"), (1, 1, "user", "there <part> x"), (1, 2, "assistant", "\\### a </turn>\n### user:\n"), (1, 3, "assistant", ""), (2, 5, None, None), (2, 5, None, None),
    (3, 1, "assistant", "b\\"), (3, 0, "odd:\n</turn> role", "a"), (None, 0, "user", "no id"), (4, 1, "assistant", "tie b"), (4, 1, "assistant", "tie a"), (5, None, "user", "null turn"),
]


def test_chat_round_trip(spark):
    d = spark.createDataFrame([(*t, "x") for t in TURNS], "conv_id long, turn long, role string, text string, formatted string")
    got = chat.format_conversations(d).select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"), "segments").collect()
    want = {}
    for c, n, r, t in sorted(TURNS, key=lambda x: (x[0] or -1, -1 if x[1] is None else x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    assert {g["conv_id"]: [tuple(t) for t in g["turns"]] for g in got} == want
    for g in got:
        assert g["loss"] == "".join(t for r, t in want[g["conv_id"]] if r == "assistant")
        assert g["formatted"] == "".join(s["text"] for s in g["segments"])
        assert g["formatted"].count("</turn>\n") == 1 + sum(a[0] != b[0] for a, b in zip(want[g["conv_id"]], want[g["conv_id"]][1:]))
    assert chat.format_conversations(d.limit(0)).count() == 0


TEXTS = ["Hello  world\n\n it's the 1st test!", "<|endoftext|>a<|endoftext|> ", "", None, "é😀漢字 ñandú\u3000\x1c\x85", "a" * 3000, " " * 500 + "x", "thththndtily " * 200, "ab" * 500, "\ua7ce\u0558 \ua7cb", "'s 'S don't we'll"]


def test_bpe(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    d = spark.createDataFrame([(i, x, "old") for i, x in enumerate(TEXTS * 2)], "doc_id long, text string, ids string")
    for r in bpe.decode(bpe.encode(d)).collect():
        want = t.encode(r["text"] or "", add_special_tokens=False).ids
        assert np.frombuffer(bytes(r["ids"]), np.uint32).tolist() == want and r["n_tokens"] == len(want)
        assert r["decoded_text"] == t.decode(want, skip_special_tokens=False) == (r["text"] or "")
    assert bpe.decode(bpe.encode(d.limit(0))).count() == 0


def test_bpe_hypothesis():
    from hypothesis import given, settings
    from hypothesis import strategies as st
    from tokenizers import Tokenizer

    t, v = Tokenizer.from_file(bpe.default_path()), bpe.Vocabulary(open(bpe.default_path(), "rb").read())

    @settings(max_examples=300, deadline=None)
    @given(st.text(st.characters(exclude_categories=("Cs",)), max_size=80) | st.text("abeinrst '\n12", max_size=80))
    def same(x):
        packed = v.encode(x)
        assert np.frombuffer(packed, np.uint32).tolist() == t.encode(x, add_special_tokens=False).ids
        assert v.decode([packed]) == [x]

    same()


def counts(t):
    t = t or ""
    w = re.findall("[^\x20\x09-\x0d]+", t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    return len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


RULE_TEXTS = [None, "", " \n\t", "a b", "a b c a b c", "x " * 400, "a b a b a b\na b a b a b\n\n \n", "one two three four\x0bone two three é|<>", "\n".join(["Same line here again."] * 30), "w1 w2 w3 " + " ".join(f"u{i}" for i in range(300)) + " w1 w2 w3\u00a0w4"]


def test_quality_counts(spark):
    d = spark.createDataFrame([(i, t, 9) for i, t in enumerate(RULE_TEXTS)] * 2, "doc_id long, text string, n_words int")
    for r in quality.base_counts(d).collect():
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == counts(RULE_TEXTS[r["doc_id"]])
    assert quality.judge(d.limit(0)).count() == 0


def test_quality_verdicts(spark):
    good = "This is a plain sentence of some twelve words that ends well, honestly.\n" * 1
    prose = "\n".join(" ".join(f"word{chr(97 + (i * 11 + k) % 26)}{i}{k}" for k in range(11)) + "." for i in range(12))
    rows = [
        (1, prose, True), (2, prose + "\nAll rights reserved.\nHome | About | Contact", True), (3, "\n".join(f"Home{i} | About{i} | News{i} | Contact{i} | Help{i}" for i in range(40)), False),
        (4, " ".join(f"wort{i}### zeichen{i}$$$" for i in range(60)), False), (5, prose.upper(), False), (6, good, False), (7, "\n".join(f"menu item {i}" for i in range(60)), False),
    ]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    judged = {r["doc_id"]: r for r in quality.judge(d).collect()}
    assert {i: judged[i]["kept"] for i in judged} == {i: k for i, _, k in rows}
    assert judged[2]["cleaned_text"] == prose and judged[2]["n_lines_removed"] == 2 and judged[6]["base_failed"]
    assert quality.judge(d).where("kept").select("doc_id").count() == 2  # a filter on the verdict is not pushed below the words


def test_a_line_is_judged_by_itself(spark):
    """The same line gets the same verdict whatever else the text says."""
    lines = ["A B C D E F G H I J K L.", "A b c D e f G h. I j k.", "THE END IS NEAR, FRIENDS.", "All  rights\treserved.", "Terms   of use apply here as they did before.", "a | b | c", "plain words that end in a mark here, as they should."]
    around = ["", "NASA", "Quiet prose without much in it, which goes on.", "ALL CAPITALS HERE", "x ||| y", "tab\there"]
    rows = [(i, f"{a}\n{x}\n{a}") for i, (x, a) in enumerate((x, a) for x in lines for a in around)]
    kept = {r["doc_id"]: x in r["cleaned_text"].split("\n") for (i, t), r in zip(rows, sorted(quality.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect(), key=lambda r: r["doc_id"]), strict=True) for x in [t.split("\n")[1]]}
    for n, x in enumerate(lines):
        verdicts = {kept[n * len(around) + k] for k in range(len(around)) if around[k] != x}
        assert verdicts == {x.startswith(("plain", "A b"))}, x


def test_long_text_with_clashes(spark, monkeypatch):
    """A text of 200,000 words whose windows all clash is still counted, by sorting and not pair by pair."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *a: F.lit(0).cast("long"))
    text = " ".join(f"w{i}" for i in range(100_000)) + " " + " ".join(f"w{i}" for i in range(100_000, 0, -1)) + " w1 w2 w3"
    r = quality.base_counts(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert (r["n_words"], r["n_repeat_words"]) == (len(text.split()), counts(text)[4])


def test_quality_hash_clash(spark, monkeypatch):
    """With one hash for every window, the exact path finds the same counts."""
    monkeypatch.setattr(quality.F, "xxhash64", lambda *a: F.lit(0).cast("long"))
    texts = ["a b c d a b c", "a b c d e f", "x y x y x y z"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["n_repeat_words"] for r in quality.base_counts(d).collect()} == {i: counts(t)[4] for i, t in enumerate(texts)}


@pytest.mark.parametrize("x", ["plain", "\\", "</turn>", "\\</turn>", "<part>\\", "####", "\\\\###\\"])
def test_escape(spark, x):
    r = spark.range(1).select(chat.escape(F.lit(x)).alias("e"), chat.unescape(chat.escape(F.lit(x))).alias("u")).first()
    assert r["u"] == x and "</turn>" not in r["e"] and "<part>" not in r["e"]
    assert hashlib.sha256(r["u"].encode()).digest() == hashlib.sha256(x.encode()).digest()
