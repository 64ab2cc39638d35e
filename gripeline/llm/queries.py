"""The queries of the corpus operators, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bytebpe, centroids, chat, decontamination, importance, language, licences, lm, quality, simhash, suffixes, units


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    n = spark.sparkContext.defaultParallelism
    # a table of a few row groups is dealt out, so that all cores work on it
    return df.repartition(n) if name == "documents" and 2 * df._jdf.queryExecution().toRdd().getNumPartitions() <= n else df


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    done = chat.format_conversations(_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more))
    done = done.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


SQL_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, row_number() OVER w AS n, lag(role) OVER w AS prev,
    replace(replace(replace(replace(text, '\', '\\'), '</turn>', '<\/turn>'), '<part>', '<\part>'), '###', '\###') AS safe,
    replace(replace(replace(replace(replace(role, '\', '\\'), '</turn>', '<\/turn>'), '<part>', '<\part>'), '###', '\###'), chr(10), '\' || chr(10)) AS head
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  length(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(safe) + CASE WHEN n = 1 THEN 6 + length(head) WHEN prev = role THEN 6 ELSE 14 + length(head) END) + 8 AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


def op2_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = units.remove_repeated_units(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("removed_spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return found.select("doc_id", "n_units", removed.alias("removed_chars"), "removed_spans", "kept_text")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded_text", "UTF-8"), 256).alias("decoded_sha256"))


def documents_as_files(docs: DataFrame) -> DataFrame:
    """Documents have no path; as files they lie in a directory of their language below one of their source."""
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), F.coalesce("lang", F.lit("")), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return docs.select("doc_id", path.alias("path"), "text")


def op5_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(documents_as_files(_table(spark, sf_dir, "documents"))).select("doc_id", "path", "licence", F.round("similarity", 4).alias("similarity"), "origin", "from_dir")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = language.fit(docs.where(~held_out).select("text", "lang"))
    found = language.predict(docs.select("doc_id", "text", held_out.alias("held_out")), model, keep_text=False)
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op8_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.remove_repeats(_table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + (x["end"] - x["start"]))
    return found.select(
        "doc_id", (F.octet_length("kept") + removed).cast("long").alias("n_bytes"), removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shared", "n_item", F.round("containment", 6).alias("containment"))


SQL_OP9 = r"""
WITH w AS (
  SELECT 0 AS kind, doc_id AS id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM documents
  UNION ALL SELECT 1, item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') FROM benchmark),
s AS (SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT kind, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT id, count(*) AS n FROM s WHERE kind = 1 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, n.n AS n_item, round(count(*) / n.n, 6) AS containment
FROM s d JOIN s b ON b.s = d.s AND b.kind = 1 AND d.kind = 0 JOIN n ON n.id = b.id
GROUP BY d.id, b.id, n.n HAVING count(*) >= 0.8 * n.n
"""


def op10_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm.stupid_backoff(_table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


SQL_OP10 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
t AS (
  SELECT r, i, w[i] AS w1, CASE WHEN i >= 2 THEN w[i-1] || ' ' || w[i] END AS w2, CASE WHEN i >= 3 THEN w[i-2] || ' ' || w[i-1] || ' ' || w[i] END AS w3,
    CASE WHEN i >= 2 THEN w[i-1] END AS p1, CASE WHEN i >= 3 THEN w[i-2] || ' ' || w[i-1] END AS p2
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
g AS (SELECT r, w1 AS g, 1 AS o FROM t UNION ALL SELECT r, w2, 2 FROM t WHERE w2 IS NOT NULL UNION ALL SELECT r, w3, 3 FROM t WHERE w3 IS NOT NULL),
own AS (SELECT o, r, g, count(*) AS n FROM g GROUP BY o, r, g),
al AS (SELECT o, r, g, sum(n) OVER (PARTITION BY o, g) - n AS c FROM own),
n AS (SELECT count(*) AS n FROM t),
s AS (
  SELECT t.r, t.i, greatest((SELECT n FROM n) - len(d.w), 1) AS rest, a1.c AS c1, a2.c AS c2, a3.c AS c3, b1.c AS b1, b2.c AS b2
  FROM t JOIN d ON d.r = t.r JOIN al a1 ON a1.o = 1 AND a1.r = t.r AND a1.g = t.w1
  LEFT JOIN al a2 ON a2.o = 2 AND a2.r = t.r AND a2.g = t.w2 LEFT JOIN al a3 ON a3.o = 3 AND a3.r = t.r AND a3.g = t.w3
  LEFT JOIN al b1 ON b1.o = 1 AND b1.r = t.r AND b1.g = t.p1 LEFT JOIN al b2 ON b2.o = 2 AND b2.r = t.r AND b2.g = t.p2),
u AS (SELECT *, greatest(c1, 1)::DOUBLE / rest::DOUBLE AS s1 FROM s),
v AS (SELECT *, CASE WHEN i < 2 THEN s1 WHEN c2 > 0 THEN c2::DOUBLE / b1::DOUBLE ELSE 0.4::DOUBLE * s1 END AS s2 FROM u),
x AS (SELECT r, sum(ln(CASE WHEN i < 3 THEN s2 WHEN c3 > 0 THEN c3::DOUBLE / b2::DOUBLE ELSE 0.4::DOUBLE * s2 END)) AS l FROM v GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, round(coalesce(x.l, 0), 4) AS log_score, round(x.l / len(d.w), 6) AS mean_log_score
FROM d LEFT JOIN x ON x.r = d.r
"""


_BOILER = "regexp_matches({x}, '" + "|".join(quality.BOILERPLATE) + "')"
_ENDS = ", ".join(f"'{c}'" for c in quality.ENDS)
SQL_OP6 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
g AS (SELECT r, i, w[i:i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) > 2)),
p AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, i + unnest([0, 1, 2]) AS k FROM p) GROUP BY r),
l AS (SELECT r, t, x, trim(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')) AS y FROM (SELECT r, t, unnest(string_split(t, chr(10))) AS x FROM d)),
k AS (SELECT *, length(y) - length(replace(y, ' ', '')) + 1 AS n, length(y) - length(regexp_replace(y, '[#*$%&|<>]', '', 'g')) AS symbols, length(y) - length(replace(y, '|', '')) AS bars,
  length(regexp_replace(y, '[^\p{{L}}]+', '', 'g')) AS letters, length(regexp_replace(y, '[^\p{{Lu}}]+', '', 'g')) AS capitals,
  right(regexp_replace(y, '["''»”’)\]\s]+$', ''), 1) AS bare FROM l),
v AS (SELECT *, CASE WHEN y = '' THEN true WHEN bars >= 2 AND bars > 0.2 * n THEN false WHEN symbols > 0.2 * n THEN false
  WHEN letters >= 8 AND capitals > 0.6 * letters THEN false WHEN {_BOILER.format(x="lower(y)")} THEN false
  WHEN n < 10 AND right(y, 1) NOT IN ({_ENDS}) AND bare NOT IN ({_ENDS}) THEN false ELSE true END AS ok FROM k),
s AS (SELECT r, coalesce(sum(length(x)) FILTER (ok), 0)::DOUBLE / nullif(sum(length(x)), 0) AS share, count(*) FILTER (regexp_matches(x, '[^\x20\x09-\x0D]')) - count(DISTINCT x) FILTER (regexp_matches(x, '[^\x20\x09-\x0D]')) AS dup FROM v GROUP BY r),
o AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(dup AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words, coalesce(share, 0) AS share FROM d JOIN w USING (r) JOIN s USING (r) LEFT JOIN c USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND share >= 0.5 AS kept FROM o
"""

_TERMS = ", ".join(f"({i}, '{n}', '{w}', {x!r}::DOUBLE)" for i, n, w, x in licences.vectors()[0])
_IDFS = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in licences.idfs().items())
_SPANS = " UNION ALL ".join(f"SELECT doc_id, {w} AS size, unnest(range(1, n - {w} + 2, {step})) AS a, a + {w} - 1 AS z FROM nl" for w, step in licences.WINDOWS.items())
SQL_OP5 = rf"""
WITH tv(template, licence, word, weight) AS (VALUES {_TERMS}), iv(word, idf) AS (VALUES {_IDFS}),
f AS (SELECT doc_id, text, coalesce(source, '') || '/' || coalesce(lang, '') || '/' || doc_id || '.txt' AS path, concat_ws('/', nullif(source, ''), nullif(lang, '')) AS dir FROM documents),
l0 AS (SELECT doc_id, k, regexp_extract_all(translate(string_split(text, chr(10))[k], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+') AS w
  FROM (SELECT *, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM f)),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS line, w FROM l0 WHERE len(w) > 0),
nl AS (SELECT doc_id, count(*) AS n FROM l GROUP BY doc_id),
sp AS (SELECT DISTINCT doc_id, a, z FROM ({_SPANS} UNION ALL SELECT doc_id, n, 1, n FROM nl) WHERE z >= a),
lw AS (SELECT doc_id, line, word, count(*) AS c FROM (SELECT doc_id, line, unnest(w) AS word FROM l) GROUP BY ALL),
x AS (SELECT sp.doc_id, a, z, lw.word, sum(c) * any_value(coalesce(idf, {licences.vectors()[1]!r}::DOUBLE)) AS v, any_value(idf) AS idf
  FROM sp JOIN lw ON lw.doc_id = sp.doc_id AND lw.line BETWEEN a AND z LEFT JOIN iv ON iv.word = lw.word GROUP BY ALL),
nm AS (SELECT doc_id, a, z, sqrt(sum(v * v)) AS norm, sqrt(coalesce(sum(v * v) FILTER (idf IS NOT NULL), 0)) AS in_templates FROM x GROUP BY ALL),
dt AS (SELECT x.doc_id, x.a, x.z, template, licence, round(sum(v * weight) / any_value(norm), 6) AS s FROM x JOIN nm USING (doc_id, a, z) JOIN tv USING (word) WHERE in_templates >= {licences.THRESHOLD - 0.001} * norm GROUP BY ALL),
m AS (SELECT * FROM dt WHERE s >= {licences.THRESHOLD}),
sh AS (SELECT l.doc_id, sum(len(l.w)) FILTER (EXISTS (SELECT 1 FROM m WHERE m.doc_id = l.doc_id AND l.line BETWEEN m.a AND m.z))::DOUBLE / sum(len(l.w)) AS share FROM l GROUP BY l.doc_id),
own AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY s DESC, z - a, a, template) = 1),
o AS (SELECT f.doc_id, f.path, f.dir, own.licence, own.s, sh.share FROM f LEFT JOIN own ON own.doc_id = f.doc_id LEFT JOIN sh ON sh.doc_id = f.doc_id),
df AS (SELECT * FROM (SELECT dir, licence, s, row_number() OVER (PARTITION BY dir ORDER BY s DESC, licence) AS k FROM o WHERE licence IS NOT NULL AND share >= {licences.FILE_SHARE}) WHERE k = 1)
SELECT doc_id, path, coalesce(o.licence, df.licence) AS licence, round(coalesce(o.s, df.s), 4) AS similarity,
  CASE WHEN o.licence IS NOT NULL THEN 'own' WHEN df.licence IS NOT NULL THEN 'inherited' END AS origin, CASE WHEN o.licence IS NULL AND df.licence IS NOT NULL THEN o.dir END AS from_dir
FROM o LEFT JOIN df USING (dir)
"""



def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bytebpe.decode(bytebpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return done.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.cluster(_table(spark, sf_dir, "embeddings"))
    centroid = F.array_join(F.col("centroid").cast("array<string>"), ",")
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2(centroid, 256).alias("centroid_sha256"))


def _sql_op12() -> str:
    """Rounds of assignment and means, one common table after another."""
    nearest = """a{r} AS (SELECT id, x, k, d FROM (
  SELECT v.id, v.n, v.x, c.k, CAST(list_sum([(v.x[i] - c.x[i]) * (v.x[i] - c.x[i]) for i in range(1, 65)]) AS BIGINT) AS d FROM v CROSS JOIN c{r} c)
  QUALIFY row_number() OVER (PARTITION BY n ORDER BY d, k) = 1)"""
    means = """c{s} AS (SELECT k, coalesce(m.x, c.x) AS x FROM c{r} c LEFT JOIN (
  SELECT k, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT k, i, CAST(sum(x[i]) AS BIGINT) AS s, count(*) AS n FROM (SELECT k, x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY k, i) GROUP BY k) m USING (k))"""
    rounds = ",\n".join(nearest.format(r=r) + (",\n" + means.format(r=r, s=r + 1) if r < 3 else "") for r in range(4))
    return f"""
WITH v AS (SELECT row_number() OVER () AS n, vec_id AS id, [CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT) for e in embedding] AS x FROM embeddings
  WHERE len(embedding) = 64 AND len([e for e in embedding if e IS NOT NULL AND isfinite(e)]) = 64),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || id), x) - 1 AS k, x FROM v QUALIFY k < 16),
{rounds}
SELECT id AS vec_id, CAST(k AS INTEGER) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256
FROM a3 JOIN c3 USING (k)
"""


SQL_OP12 = _sql_op12()


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat": op1_chat,
    "op2_units": op2_units,
    "op3_simhash": op3_simhash,
    "op4_bpe": op4_bpe,
    "op5_licences": op5_licences,
    "op6_quality": op6_quality,
    "op7_language": op7_language,
    "op8_suffixes": op8_suffixes,
    "op9_decontamination": op9_decontamination,
    "op10_lm": op10_lm,
    "op11_byte_bpe": op11_byte_bpe,
    "op12_centroids": op12_centroids,
    "op13_importance": op13_importance,
}
SQL: dict[str, str] = {"op1_chat": SQL_OP1, "op5_licences": SQL_OP5, "op6_quality": SQL_OP6, "op9_decontamination": SQL_OP9, "op10_lm": SQL_OP10, "op12_centroids": SQL_OP12}
