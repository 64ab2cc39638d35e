"""Operator 7: language identification, words first, then shorter and shorter character n-grams.

``fit`` counts words and, within words, character n-grams by language over a sample of the labelled texts: at most
``docs_per_language`` different ones of each language, those of smallest hash, each counted once however often it stands. That
bound on labelled rows is the only one; every word and n-gram of the sample is kept, so the model is as large as the sample has
distinct ones. ``predict`` adds up, over the words of a text, the log frequency of a known word in each language; an unseen word
falls back to its n-grams of ``longest`` characters, and to shorter ones as long as none of them is known. The language with the
largest sum wins (ties: the first by name); ``score`` is its share when the mean scores of a word are set against each other.

Texts that are null or without letters get ``und`` and score 0, as do all texts when nothing was learned. Labels that are null
teach nothing. A text of any length is predicted whole, in one task. Prediction goes row by row: null ids are carried along,
repeated rows each get the same, an empty table gives an empty one. Columns of the input are kept; lang_pred and score win over
input columns of the same name.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Cuts, small_batches

CACHE = 200_000


@dataclass(frozen=True)
class Settings:
    docs_per_language: int = 4000
    longest: int = 4
    #: What each step down costs, as a factor of a word's probability.
    backoff: float = 0.4


def sample(labelled: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, text): at most ``docs_per_language`` different texts of each language, those of smallest hash.

    A first cut by hash leaves some thrice as many, so that no window sees more than a few thousand rows of a language.
    """
    d = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    share = {r["lang"]: min(1.0, 3 * settings.docs_per_language / r["count"]) for r in d.groupBy("lang").count().collect()}
    if not share:
        return d
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    limit = F.element_at(F.create_map(*(F.lit(x) for kv in share.items() for x in kv)), F.col("lang"))
    d = d.where(part < limit).select("lang", part.alias("part"), "text").dropDuplicates(["lang", "text"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("part", "text"))
    return d.withColumn("place", place).where(F.col("place") <= settings.docs_per_language).select("lang", "text")


def fit(labelled: DataFrame, settings: Settings = Settings(), text_col: str = "text", lang_col: str = "lang") -> bytes:
    """The model, as Arrow data, from rows of text and label. It is collected; its size is bounded by that of the sample and the languages."""
    words = sample(labelled, settings, text_col, lang_col).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("g"))
    cuts = Cuts(labelled.sparkSession, "language")
    words = cuts.cut(words.groupBy("lang", "g").count().select("lang", F.lit(0).alias("n"), "g", F.col("count").alias("c")))
    padded = F.concat(F.lit(" "), F.col("g"), F.lit(" "))
    grams = F.explode(F.flatten(F.transform(
        F.array(*(F.lit(n) for n in range(1, settings.longest + 1))),
        lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(padded) - n + 1, F.lit(1))), lambda i: F.struct(n.alias("n"), F.substring(padded, i, n).alias("g"))),
    )))
    grams = words.select("lang", "c", grams.alias("x")).where(F.char_length("x.g") == F.col("x.n")).groupBy("lang", F.col("x.n").alias("n"), F.col("x.g").alias("g")).agg(F.sum("c").alias("c"))
    languages = [r["lang"] for r in words.select("lang").distinct().orderBy("lang").collect()]
    by_lang = F.map_from_entries(F.collect_list(F.struct("lang", "c")))  # an entry a language
    found = words.unionByName(grams).groupBy("n", "g").agg(by_lang.alias("c"))
    found = found.select("n", "g", F.transform(F.lit(languages).cast("array<string>"), lambda x: F.coalesce(F.col("c")[x], F.lit(0)).cast("int")).alias("c"))
    table = found.orderBy("n", "g").toArrow().replace_schema_metadata({"model": json.dumps({"languages": languages, "backoff": settings.backoff, "longest": settings.longest})})
    cuts.drop(words)
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_table(table)
    return out.getvalue().to_pybytes()


class _Model:
    def __init__(self, data: bytes):
        import regex

        table = pa.ipc.open_stream(data).read_all()
        m = json.loads(table.schema.metadata[b"model"])
        self.languages = m["languages"]
        self.letters = regex.compile(r"\p{L}+").findall
        if self.languages:
            self.step = float(np.log(m["backoff"]))
            self.tables = []
            for n in range(m["longest"] + 1):
                part = table.filter(pc.equal(table["n"], n)).combine_chunks()
                counts = pc.list_flatten(part["c"]).to_numpy().reshape(part.num_rows, len(self.languages)).astype(np.float64)
                # what a language never says counts as half an occurrence in the largest sample, so that little text makes nothing likely
                total = np.maximum(counts.sum(0), 1)
                at = np.log(np.where(counts > 0, counts / total, 0.5 / total.max())).astype(np.float32)
                self.tables.append((dict(zip(part["g"].to_pylist(), range(part.num_rows), strict=True)), at))
            self.rows = np.zeros((CACHE + len(self.tables[0][0]), len(self.languages)), np.float32)
            self.reset()

    def reset(self) -> None:
        known, at = self.tables[0]
        self.known = dict(known)
        self.rows[: len(at)] = at

    def unseen(self, word: str) -> np.ndarray:
        padded = f" {word} "
        cost = self.step
        for n in range(len(self.tables) - 1, 0, -1):
            known, at = self.tables[n]
            found = [known[g] for i in range(len(padded) - n + 1) if (g := padded[i : i + n]) in known]
            if found:
                return at[found].mean(0) + cost
            cost += self.step
        return np.full(len(self.languages), cost, np.float32)

    def predict(self, text: str | None) -> tuple[str, float]:
        found = self.letters(text.lower()) if text and self.languages else []
        if not found:
            return "und", 0.0
        total = np.zeros(len(self.languages))
        known, rows = self.known, self.rows
        for a in range(0, len(found), 100_000):
            idx = []
            for w in found[a : a + 100_000]:
                i = known.get(w)
                if i is None:
                    if len(known) == len(rows):
                        total += rows[idx].sum(0, dtype=np.float64)
                        idx = []
                        self.reset()
                        known = self.known
                    i = len(known)
                    rows[i] = self.unseen(w)
                    known[w] = i
                idx.append(i)
            total += rows[idx].sum(0, dtype=np.float64)
        mean = total / len(found)
        best = int(mean.argmax())
        return self.languages[best], float(1 / np.exp(mean - mean[best]).sum())


_LOADED: dict[int, _Model] = {}


def predict(docs: DataFrame, model: bytes, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with lang_pred (string) and score (double, 0 to 1); without its text if asked for."""
    small_batches(docs.sparkSession)
    d = docs.drop("lang_pred", "score")
    kept = d.columns if keep_text else [c for c in d.columns if c != text_col]
    names = [*kept, "lang_pred", "score"]
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shipped.value)
        if key not in _LOADED:
            _LOADED.clear()
            _LOADED[key] = _Model(shipped.value)
        m = _LOADED[key]
        for b in batches:
            found = [m.predict(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array([x for x, _ in found], pa.string()), pa.array([y for _, y in found], pa.float64())], names=names)

    return d.mapInArrow(run, d.select(*kept, F.lit("").alias("lang_pred"), F.lit(0.0).alias("score")).schema)
