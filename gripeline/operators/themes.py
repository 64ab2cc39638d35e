"""Sub-themes: what the contacts of a leaf say that others do not, and exemplars.

TF-IDF: words are extracted once and written; batches of contacts ask for the document frequencies of their 1- and 2-grams, which are added
up by term, and count and weight the terms within the bounds by contact; leaf means and background means come from sums by leaf and term.
"""

from __future__ import annotations

import math
from string import ascii_lowercase

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import DEFAULT, Config
from ..folders import Tables
from ..functions.text import with_snippet

#: Words and artefacts of support talk that carry no theme (fixed values: TF-IDF weights and sub-themes depend on each of them, so
#: the list has to be this one for equal results).
DOMAIN_STOPWORDS = (
    "dm", "pm", "dms", "please", "sorry", "hi", "hey", "hello", "thanks", "thank", "team", "send", "us", "know", "let", "ll", "ve", "re",
    "hear", "help", "happy", "apologies", "apologize", "reach", "able", "look", "looking", "looked", "info", "information", "account",
    "number", "email", "phone", "name", "zip", "details", "detail", "assist", "issue", "issues", "concern", "concerns", "experience",
    "service", "customer", "order", "orders", "amp", "https", "http", "com", "www", "dont", "didnt", "cant", "wont", "ive", "im", "youre",
    "weve", "thats", "got", "get", "would", "could", "like", "want", "need", "just", "going", "make", "sure", "today", "day", "days", "week",
    "time", "back", "still", "via", "also", "one", "see", "take", "way", "thank_you", "let_us", "send_us", "reach_out", "dm_us", "happened",
    "thing", "things", "guys", "gonna", "wanna", "yall", "lol", "yeah", "okay", "oh", "good", "really", "guy", "people", "say", "said", "tell",
)


#: English function words of three letters or more.
ENGLISH_STOPWORDS = """
about above across after afterwards again against all almost alone along already although always among and another any anyhow anyone
anything anyway anywhere are around because been before beforehand behind being below beside besides between beyond both but
cannot could did does doing done down during each either else elsewhere enough etc even ever every everyone everything everywhere few
first for former from further had has have having hence her here hereafter hers herself him himself his how however indeed into its
itself last latter least less many may meanwhile might mine more moreover most mostly much must myself namely neither never
nevertheless next nobody none nor not nothing now nowhere off often once only onto other others otherwise our ours ourselves out over
own per perhaps rather same seem seemed seeming seems several she should since some somehow someone something sometime sometimes
somewhere such than that the their them themselves then thence there thereafter therefore these they this those though through
throughout thus together too toward towards under until upon very was well were what whatever when whence whenever where whereas
wherever whether which while who whoever whole whom whose why will with within without yet you your yours yourself yourselves
""".split()


def stop_words() -> list[str]:
    return sorted(set(ENGLISH_STOPWORDS) | set(DOMAIN_STOPWORDS))


def grams(text: Column, stops: list[str]) -> Column:
    """Words of three letters or more without stop words, and pairs of words that are neighbours once these are gone."""
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}_]+")
    plain = lambda w: (F.char_length(w) >= 3) & (F.translate(w, ascii_lowercase, "") == "")
    return F.filter(words, lambda w: plain(w) & ~w.isin(*stops))


def tokenised(a: DataFrame, tables: Tables, stops: list[str] | None = None) -> DataFrame:
    """(conversation_id, l5_id, w): the words of each contact without stop words, one space between, written once for all that counts them."""
    texts = a.select("conversation_id", "l5_id", "text").repartition("conversation_id")  # a table of one file is one task otherwise
    return tables.cut(texts.select("conversation_id", "l5_id", F.array_join(grams(F.col("text"), stop_words() if stops is None else stops), " ").alias("w")))


def _terms(contacts: pa.Table) -> tuple[np.ndarray, pa.DictionaryArray]:
    """The words and pairs of neighbours of a batch's contacts, each with the row that it is from."""
    w = pc.split_pattern(contacts.column("w").combine_chunks(), " ")
    flat, row = pc.list_flatten(w), np.repeat(np.arange(len(w)), pc.list_value_length(w).to_numpy(zero_copy_only=False))
    full = pc.not_equal(flat, "")  # no words at all
    flat, row = flat.filter(full), row[full.to_numpy(zero_copy_only=False)]
    at = np.flatnonzero(row[1:] == row[:-1])
    pairs = pc.binary_join_element_wise(flat.take(pa.array(at)), flat.take(pa.array(at + 1)), " ")
    return np.concatenate([row, row[at]]), pa.concat_arrays([flat, pairs]).dictionary_encode()


def _asked(contacts: pa.Table) -> pa.Table:
    """(b, term, n): in how many contacts of a batch each of its terms is."""
    row, terms = _terms(contacts)
    each = np.unique(row * len(terms.dictionary) + terms.indices.to_numpy()) % max(1, len(terms.dictionary))
    n = np.bincount(each, minlength=len(terms.dictionary))
    b = contacts.column("b")[0].as_py()
    return pa.table({"b": pa.array([b] * len(n), pa.int32()), "term": terms.dictionary, "n": pa.array(n, pa.int64())}).sort_by("term")


def _weighted(schema: pa.Schema):
    """A batch's contacts and the (term, idf) told of its terms to rows of ``schema``."""

    def run(contacts: pa.Table, told: pa.Table) -> pa.Table:
        if not contacts.num_rows or not told.num_rows:
            return schema.empty_table()
        row, terms = _terms(contacts)
        place = pc.index_in(terms.dictionary, told.column("term").combine_chunks()).fill_null(-1).to_numpy()[terms.indices.to_numpy()]
        row, place = row[place >= 0], place[place >= 0]
        ids, leaves = (contacts.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("conversation_id", "l5_id"))
        conv, leaf, k = ids.indices.to_numpy()[row].astype(np.int64), leaves.indices.to_numpy()[row], told.num_rows
        key, tf = np.unique((conv * len(leaves.dictionary) + leaf) * k + place, return_counts=True)
        conv, leaf, place = key // k // len(leaves.dictionary), key // k % len(leaves.dictionary), key % k
        raw = (1 + np.log(tf)) * told.column("idf").to_numpy()[place]
        norm = np.sqrt(np.bincount(conv, raw * raw, minlength=len(ids.dictionary)))
        take = lambda x, i: x.take(pa.array(i))
        return pa.table([take(ids.dictionary, conv), take(leaves.dictionary, leaf), take(told.column("term"), place), pa.array(tf, pa.int64()), pa.array(raw / norm[conv])], schema=schema)

    return run


#: Bytes of words of a batch.
BATCH = 4 << 20


def tfidf(a: DataFrame, min_df: int = 5, max_df: float = 0.4, stops: list[str] | None = None, words: DataFrame | None = None) -> DataFrame:
    """(conversation_id, l5_id, term, tf, weight): L2-normalised over the terms kept. ``words`` is what ``tokenised`` gave for ``a``.

    Contacts lie in batches by conversation. A batch asks once for each of its different terms, wherever these are, and is told the weights
    of those within the bounds; the terms of single contacts are never shuffled, and a batch is counted in memory.
    """
    words = tokenised(a, Tables(a.sparkSession, "themes"), stops) if words is None else words
    total, n = words.agg(F.coalesce(F.sum(F.octet_length("w")), F.lit(0)), F.count("*")).first()
    least = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(math.ceil(total / BATCH), min(least, math.ceil(total / (BATCH >> 4))), 1)
    batches = words.select(F.pmod(F.xxhash64("conversation_id", F.lit("batch")), F.lit(parts)).cast("int").alias("b"), "conversation_id", "l5_id", "w").groupBy("b")
    df = F.sum("n").over(Window.partitionBy("term"))
    asked = batches.applyInArrow(_asked, "b int, term string, n long").repartition(max(parts, least), "term").select("b", "term", df.alias("df"))
    told = asked.where((F.col("df") >= min_df) & (F.col("df") <= max_df * n)).select("b", "term", (F.log((1 + F.lit(n)) / (1 + F.col("df"))) + 1).alias("idf"))
    kinds = {f.name: f.dataType for f in words.schema}
    out = T.StructType([*(T.StructField(c, kinds[c]) for c in ("conversation_id", "l5_id")), *T._parse_datatype_string("term string, tf long, weight double")])
    return batches.cogroup(told.groupBy("b")).applyInArrow(_weighted(to_arrow_schema(out)), out)


def distinctive_terms(a: DataFrame, candidates: int = 25, min_docs: int = 15, **kw) -> DataFrame:
    """(l5_id, term, distinct, place): mean weight within the leaf less the mean elsewhere, zeros included."""
    sums = tfidf(a, **kw).groupBy("l5_id", "term").agg(F.sum("weight").alias("s")).withColumn("all", F.sum("s").over(Window.partitionBy("term")))  # a row a leaf
    sizes = a.groupBy("l5_id").agg(F.count("*").alias("n_cls")).withColumn("n", F.sum("n_cls").over(Window.partitionBy()))
    d = sums.join(F.broadcast(sizes.where(F.col("n_cls") >= min_docs)), "l5_id")  # one row a leaf
    rest = F.coalesce(F.try_divide(F.col("all") - F.col("s"), F.col("n") - F.col("n_cls")), F.lit(0.0))
    d = d.select("l5_id", "term", "n_cls", (F.col("s") / F.col("n_cls") - rest).alias("distinct")).where("distinct > 0")
    place = F.row_number().over(Window.partitionBy("l5_id").orderBy(F.desc(F.round("distinct", 12)), "term"))
    return d.withColumn("place", place).where(F.col("place") <= candidates)


def phrases(text: Column) -> Column:
    """Whole words of three letters or more, and pairs of them with one space between, as they stand in a text."""
    low, edge, end = F.lower(F.coalesce(text, F.lit(""))), r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
    return F.concat(F.regexp_extract_all(low, F.lit(rf"{edge}([a-z]{{3,}}){end}"), F.lit(1)), F.regexp_extract_all(low, F.lit(rf"{edge}(?=([a-z]{{3,}} [a-z]{{3,}}){end})"), F.lit(1)))


def drop_overlapping(terms: DataFrame) -> DataFrame:
    """Of each leaf's terms, in order of place, those that neither contain nor lie in one kept before."""
    ordered = terms.groupBy("l5_id").agg(F.array_sort(F.collect_list(F.struct("place", "term", "n_cls", "distinct"))).alias("t"))  # candidates are few
    first = F.slice(F.col("t"), 1, 0)
    kept = F.aggregate("t", first, lambda s, x: F.when(F.exists(s, lambda y: F.contains(y["term"], x["term"]) | F.contains(x["term"], y["term"])), s).otherwise(F.concat(s, F.array(x))))
    return ordered.select("l5_id", F.explode(kept).alias("x")).select("l5_id", "x.*")


def subthemes(a: DataFrame, top: int = 5, min_docs_per_theme: int = 4, quote_chars: int = 200, **kw) -> DataFrame:
    """(l5_id, label, place, count, share, quote, severity): themes with enough contacts that hold the phrase.

    ``a`` has text and severity. The quote is the best sentence of the most severe contact (ties by conversation_id).
    """
    terms = drop_overlapping(distinctive_terms(a, **kw))
    terms = Tables(a.sparkSession, "terms").cut(terms)  # 25 a leaf at most
    severity = F.coalesce("severity", F.lit(0.0)).alias("severity")
    said = a.select("conversation_id", "l5_id", "text", "severity").repartition("conversation_id").select("conversation_id", "l5_id", severity, F.explode(F.array_distinct(phrases(F.col("text")))).alias("term")).join(terms, ["l5_id", "term"])
    best = F.max(F.struct("severity", "conversation_id")).alias("b")
    found = said.groupBy("l5_id", "term", "place", "n_cls").agg(F.count("*").alias("count"), best).where(F.col("count") >= min_docs_per_theme)
    nth = F.row_number().over(Window.partitionBy("l5_id").orderBy("place"))
    found = found.withColumn("nth", nth).where(F.col("nth") <= top).select(
        "l5_id", F.col("term").alias("label"), F.col("nth").alias("place"), "count", (F.col("count") / F.col("n_cls")).alias("share"),
        F.col("b.conversation_id").alias("conversation_id"), F.col("b.severity").alias("severity"),
    )
    found = Tables(a.sparkSession, "themes").cut(found)  # a few rows a leaf: known to be small, so that no text is shuffled for their quotes
    quoted = a.select("conversation_id", "l5_id", F.col("text").alias("_t")).join(found.select("conversation_id", "l5_id").distinct(), ["conversation_id", "l5_id"], "left_semi")
    quoted = quoted.groupBy("conversation_id", "l5_id").agg(F.max("_t").alias("_t"))
    found = found.join(quoted, ["conversation_id", "l5_id"]).drop("conversation_id")
    return with_snippet(found, "_t", F.col("label"), 1, quote_chars, "quote").drop("_t")


def exemplars(a: DataFrame, queries: DataFrame | None = None, cfg: Config = DEFAULT) -> DataFrame:
    """(l5_id, conversation_id, place, severity, sentiment, snippet): the most severe contacts of each leaf, compressed.

    ``queries`` is (l5_id, definition); a leaf without one is queried by its id.
    """
    place = F.row_number().over(Window.partitionBy("l5_id").orderBy(F.desc("severity"), "conversation_id"))
    d = a.withColumn("place", place).where(F.col("place") <= cfg.exemplar_k)
    d = d.join(F.broadcast(queries), "l5_id", "left") if queries is not None else d.withColumn("definition", F.lit(None).cast("string"))
    query = F.coalesce(F.when(F.col("definition") != "", F.col("definition")), F.col("l5_id"))
    d = with_snippet(d, "text", query, cfg.compress_sentences, cfg.snippet_chars)
    return d.select("l5_id", "conversation_id", "place", "severity", "sentiment", "snippet")
