"""Operator 6: quality rules, line by line first, in DataFrame functions only.

Each line is judged on its own (navigation, symbols, capitals, boilerplate, end punctuation): what a line is told never depends on
the lines around it. Failing lines are removed; a document is rejected when it fails the two base rules or when too much of its
text was removed. The phrases of boilerplate are English; the other rules know no language.

Nulls, empty texts and texts of white space have no words: they fail the base rule and are rejected. Repeated rows are judged
one by one, null ids are carried along, and an empty table gives an empty one. A text of any length is one row and one task's work, which grows with its length times the logarithm of it. Columns of
the input are kept; the columns added here win over input columns of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACES, words

#: Boilerplate phrases (lower case); a line with one of them is removed.
BOILERPLATE = (
    "all rights reserved", "licensed under", "released under the", "is licensed under", "terms of use", "privacy policy",
    "cookie policy", "lorem ipsum", "click here", "sign up for", "subscribe to our", "share this", "javascript is disabled",
)
SYMBOLS = "#*$%&|<>"
#: Marks that end a sentence.
ENDS = tuple(".!?…:;。！？")


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: A line of fewer words that ends in no sentence mark is a heading or menu item.
    unpunctuated_words: int = 10
    #: Separators a line may hold before it counts as navigation, as a share of its words.
    max_symbol_share: float = 0.2
    #: Share of capitals among a line's letters beyond which it is shouting.
    max_capital_share: float = 0.6
    min_letters: int = 8
    #: Share of a document's characters that has to survive.
    min_kept_share: float = 0.5


def _pos_bits(n: Column) -> Column:
    """Bits that hold every position below n."""
    return F.length(F.bin(F.greatest(n, F.lit(1)).cast("long")))


def _fixed(d: DataFrame, own: list[str], *new: Column) -> DataFrame:
    """``own`` and ``new`` columns. The new ones come out of a generator of one row, because the optimizer would push a filter
    on them below the projections before it and then split a text into words anew for each place it looks at."""
    return d.select(*own, F.inline(F.array(F.struct(*new))))


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words (all long).

    Repeated windows are found by sorting one long per window, hash bits above and position below; neighbours with equal hash
    bits are then compared word by word. Should two different windows of a document have equal hash bits, that document
    takes the exact path, which sorts its windows as text.
    """
    own = [c for c in docs.columns if c not in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    d = docs.select(*own, F.coalesce(F.col(text), F.lit("")).alias("_t"))
    d = d.select(*own, "_t", words(F.col("_t")).alias("_w"), F.filter(F.split("_t", "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "").alias("_l"))
    d = d.select(*own, "_t", "_w", "_l", F.size("_w").alias("_n"), _pos_bits(F.size("_w")).alias("_s"))
    d = d.select(*own, "_t", "_w", "_l", "_n", F.call_function("shiftleft", F.lit(-1).cast("long"), F.col("_s")).alias("_m"))
    w, m = F.col("_w"), F.col("_m")
    window = F.transform(
        F.when(F.col("_n") >= 3, F.sequence(F.lit(0), F.col("_n") - 3)).otherwise(F.array().cast("array<int>")),
        lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(m).bitwiseOR(i.cast("long")),
    )
    d = d.select(*own, "_t", "_w", "_l", "_n", "_m", F.sort_array(window).alias("_a"))
    a = F.col("_a")

    def place(x: Column) -> Column:
        return x.bitwiseAND(F.bitwise_not(m)).cast("int")

    def same_hash(x: Column, y: Column) -> Column:
        return F.coalesce(x.bitwiseAND(m) == y.bitwiseAND(m), F.lit(False))

    def same_words(i: Column, j: Column) -> Column:
        return (F.get(w, i) == F.get(w, j)) & (F.get(w, i + 1) == F.get(w, j + 1)) & (F.get(w, i + 2) == F.get(w, j + 2))

    hit = F.filter(a, lambda x, i: same_hash(x, F.get(a, i - 1)) | same_hash(x, F.get(a, i + 1)))
    d = d.select(*own, "_t", "_w", "_l", "_n", "_m", hit.alias("_h"))
    h = F.col("_h")
    clash = F.exists(F.transform(h, lambda x, i: same_hash(x, F.get(h, i - 1)) & ~same_words(place(x), place(F.get(h, i - 1)))), lambda x: x)
    spelt = F.transform(F.sequence(F.lit(0), F.col("_n") - 3), lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("g"), i.alias("i")))
    d = d.select(*own, "_t", "_w", "_l", "_n", "_m", "_h", F.when(clash, F.sort_array(spelt)).alias("_e"))
    e = F.col("_e")
    same_text = lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False))  # noqa: E731  words hold no blank
    exact = F.transform(F.filter(e, lambda x, i: same_text(x, F.get(e, i - 1)) | same_text(x, F.get(e, i + 1))), lambda x: x["i"])
    d = d.select(*own, "_t", "_w", "_l", "_n", F.sort_array(F.when(e.isNotNull(), exact).otherwise(F.transform("_h", place))).alias("_p"))
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.coalesce(F.least(F.lit(3), F.get(p, i + 1) - x), F.lit(3)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)
    return _fixed(
        d, own,
        F.col("_n").cast("long").alias("n_words"),
        F.char_length(F.translate("_t", " " + SPACES, "")).cast("long").alias("word_chars"),
        (F.char_length("_t") - F.char_length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        covered.alias("n_repeat_words"),
    )


def _gates(text: Column, n_symbols: Column, rules: Rules) -> Column:
    """Which rules some line of a whole text could break: one cheap pass spares most texts the costlier tests of each line.

    A gate only shuts where no line can fail. A phrase of boilerplate in a line stands in the text too, unless white space in it was
    made single. Where over half of a line's letters are capitals, two capitals follow each other with no other letter between.
    """
    low = F.lower(text)
    odd = F.rlike(text, F.lit(r"[\t\x0B\f\r]|  "))
    boiler = odd
    for phrase in BOILERPLATE:
        boiler = boiler | F.contains(low, F.lit(phrase))
    capitals = F.rlike(text, F.lit(r"\p{Lu}[^\p{L}\n]*+\p{Lu}")) if rules.max_capital_share >= 0.5 else F.lit(True)
    return F.struct(odd.alias("spaces"), (n_symbols > 0).alias("symbols"), boiler.alias("boilerplate"), capitals.alias("capitals"))


def line_verdict(line: Column, gates: Column, rules: Rules = Rules()) -> Column:
    """The first rule that a line breaks: 'navigation', 'symbols', 'shouting', 'boilerplate', 'unpunctuated'; else null.

    ``line`` holds no white space but single blanks between words; an empty line breaks no rule.
    """
    n = F.char_length(line) - F.char_length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    symbols = F.char_length(line) - F.char_length(F.translate(line, SYMBOLS, ""))
    bars = F.char_length(line) - F.char_length(F.replace(line, F.lit("|"), F.lit("")))
    letters = F.char_length(F.regexp_replace(line, r"[^\p{L}]+", ""))
    capitals = F.char_length(F.regexp_replace(line, r"[^\p{Lu}]+", ""))
    low = F.lower(line)
    boiler = F.lit(False)
    for phrase in BOILERPLATE:
        boiler = boiler | F.contains(low, F.lit(phrase))
    last = F.right(line, F.lit(1))
    bare = F.regexp_replace(line, r"""["'»”’)\]\s]+$""", "")
    return (
        F.when(line == "", F.lit(None))
        .when(gates["symbols"] & (bars >= 2) & (bars > rules.max_symbol_share * n), F.lit("navigation"))
        .when(gates["symbols"] & (symbols > rules.max_symbol_share * n), F.lit("symbols"))
        .when(gates["capitals"] & (letters >= rules.min_letters) & (capitals > rules.max_capital_share * letters), F.lit("shouting"))
        .when(gates["boilerplate"] & boiler, F.lit("boilerplate"))
        .when((n < rules.unpunctuated_words) & ~last.isin(*ENDS) & ~F.right(bare, F.lit(1)).isin(*ENDS), F.lit("unpunctuated"))
    )


def clean_lines(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` with cleaned_text, n_lines_removed (long) and kept_share (double, of the text's characters)."""
    own = [c for c in docs.columns if c not in ("cleaned_text", "n_lines_removed", "kept_share")]
    t = F.coalesce(F.col(text), F.lit(""))
    d = docs.select(*own, F.split(t, "\n").alias("_l"), _gates(t, F.char_length(t) - F.char_length(F.translate(t, SYMBOLS, "")), rules).alias("_g"))
    single = lambda x: F.trim(F.when(F.col("_g.spaces"), F.regexp_replace(x, r"[\x20\x09-\x0D]+", " ")).otherwise(x))
    d = d.select(*own, "_l", "_g", F.transform("_l", single).alias("_s"))  # a column of its own: a rule looks at its line several times
    d = d.select(*own, "_l", F.filter("_l", lambda _, i: line_verdict(F.get("_s", i), F.col("_g"), rules).isNull()).alias("_k"))
    left = F.char_length(F.array_join("_k", "")).cast("double")
    d = _fixed(
        d, [*own, "_k"],
        (F.size("_l") - F.size("_k")).cast("long").alias("n_lines_removed"),
        F.coalesce(F.try_divide(left, F.char_length(F.array_join("_l", ""))), F.lit(0.0)).alias("kept_share"),
    )
    return d.select(*own, F.array_join("_k", "\n").alias("cleaned_text"), "n_lines_removed", "kept_share")


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """``docs`` with the base counts, cleaned_text, n_lines_removed, kept_share, base_failed and kept."""
    d = clean_lines(base_counts(docs, text), rules, text)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    own = [c for c in d.columns if c not in ("base_failed", "kept")]
    return d.select(*own, failed.alias("base_failed"), (~failed & (F.col("kept_share") >= rules.min_kept_share)).alias("kept"))
