"""Queries of the graph's store and walks, of vectors and their clusters; the same in DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as ad
from .config import SIGNALS
from .graph_queries import PACK, shared_folder
from .operators import density
from .plans import graph as gr
from .plans import search
from .queries import nodes_of, query
from .sources import model_tagger, tagger


def trade_edges(spark: SparkSession, d: str) -> DataFrame:
    """What belongs to what: suppliers to parts, parts to orders, these to customers, nations and regions."""
    t = {n: ad.table(spark, d, n) for n in ("region", "nation", "customer", "orders", "lineitem")}
    key = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    rows = [
        t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select(key("n", "n_nationkey").alias("src"), F.col("r_name").alias("dst")),
        t["customer"].select(key("c", "c_custkey").alias("src"), key("n", "c_nationkey").alias("dst")),
        t["orders"].select(key("o", "o_orderkey").alias("src"), key("c", "o_custkey").alias("dst")),
        t["lineitem"].select(key("p", "l_partkey").alias("src"), key("o", "l_orderkey").alias("dst")),
        t["lineitem"].select(key("s", "l_suppkey").alias("src"), key("p", "l_partkey").alias("dst")),
    ]
    d = rows[0]
    for x in rows[1:]:
        d = d.unionByName(x)
    return d.distinct().select(F.concat_ws(":", "src", F.lit("part_of"), "dst").alias("id"), "src", F.lit("part_of").alias("type"), "dst", F.lit("{}").alias("props"), F.lit("0").alias("updated_at"))


_WALK = """r AS (SELECT r_regionkey FROM region WHERE r_name = 'AFRICA'), n AS (SELECT n_nationkey FROM nation JOIN r ON n_regionkey = r_regionkey),
c AS (SELECT c_custkey FROM customer JOIN n ON c_nationkey = n_nationkey), o AS (SELECT o_orderkey FROM orders JOIN c ON o_custkey = c_custkey),
p AS (SELECT DISTINCT l_partkey FROM lineitem JOIN o ON l_orderkey = o_orderkey), s AS (SELECT DISTINCT l_suppkey FROM lineitem JOIN p USING (l_partkey)),
w AS (SELECT 'AFRICA' AS id, 0 AS distance UNION ALL SELECT 'n' || n_nationkey, 1 FROM n UNION ALL SELECT 'c' || c_custkey, 2 FROM c UNION ALL SELECT 'o' || o_orderkey, 3 FROM o
  UNION ALL SELECT 'p' || l_partkey, 4 FROM p UNION ALL SELECT 's' || l_suppkey, 5 FROM s)"""


@query(f"WITH {_WALK} SELECT id, distance FROM w")
def graph_walk(spark, d):
    """Six levels: from a region down to the suppliers of what its customers order."""
    return gr.traverse(trade_edges(spark, d).drop("id"), "AFRICA", depth=6, direction="in")[0]


@query(f"""WITH {_WALK}, e AS (SELECT DISTINCT * FROM (SELECT 'n' || n_nationkey AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders UNION ALL SELECT 'p' || l_partkey, 'o' || l_orderkey FROM lineitem UNION ALL SELECT 's' || l_suppkey, 'p' || l_partkey FROM lineitem))
SELECT substr(dst, 1, 1) AS kind, count(*) AS n FROM e WHERE dst IN (SELECT id FROM w) GROUP BY ALL""")
def graph_walk_edges(spark, d):
    found = gr.traverse(trade_edges(spark, d).drop("id"), "AFRICA", depth=6, direction="in")[1]
    return found.groupBy(F.substring("dst", 1, 1).alias("kind")).agg(F.count("*").alias("n"))


@query("""SELECT 'v' || vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN 'vector' WHEN vec_id % 3 = 0 THEN 'third' ELSE 'fifth' END AS type,
  '{"label":' || CASE WHEN vec_id % 5 = 0 THEN label + 1000 WHEN vec_id % 3 = 0 THEN label + 100 ELSE label END || '}' AS props, vec_id % 2 = 0 OR vec_id % 5 = 0 AS has_vector
FROM embeddings WHERE vec_id % 2 = 0 OR vec_id % 3 = 0 OR vec_id % 5 = 0""")
def graph_deltas(spark, d):
    """A base and two updates, each a segment of its own, merged by the read."""
    every = nodes_of(spark, d).withColumn("n", F.substring("id", 2, 20).cast("long"))
    label = F.get_json_object("props", "$.label").cast("long")
    of = lambda k, kind, more, vector: every.where(F.col("n") % k == 0).select(
        "id", F.lit(kind).alias("type"), F.concat(F.lit('{"label":'), (label + more).cast("string"), F.lit("}")).alias("props"), vector.cast("array<float>").alias("embedding"), "pack_version", "updated_at",
    )
    store, none = gr.Store(spark, shared_folder(spark)), gr.empty(spark)
    v = store.write(gr.Graph(of(2, "vector", 0, F.col("embedding")), none.edges, none.runs), base=0)
    v = store.commit(gr.Graph(of(3, "third", 100, F.lit(None)), none.edges, none.runs), v)
    v = store.commit(gr.Graph(of(5, "fifth", 1000, F.col("embedding")), none.edges, none.runs), v)
    return store.read(v).nodes.select("id", "type", "props", F.col("embedding").isNotNull().alias("has_vector"))


@query("""WITH q AS (SELECT 'v' || vec_id AS query, embedding AS a FROM embeddings WHERE vec_id % 100 = 0), n AS (SELECT 'v' || vec_id AS id, embedding AS b FROM embeddings),
s AS (SELECT query, id, list_cosine_similarity(CAST(a AS DOUBLE[]), CAST(b AS DOUBLE[])) AS score FROM q CROSS JOIN n)
SELECT query, id, CAST(row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS INTEGER) AS place, round(score, 6) AS score FROM s QUALIFY place <= 10""")
def vector_neighbours(spark, d):
    """The ten nearest of all vectors to each one whose id is divisible by 100, exactly."""
    nodes = nodes_of(spark, d)
    asked = nodes.where(F.substring("id", 2, 20).cast("long") % 100 == 0).select("id", "embedding")
    return gr.vector_search_many(nodes, asked, 10, exact=True).select("query", "id", F.col("place").cast("int").alias("place"), F.round("score", 6).alias("score"))


@query()
def density_clusters(spark, d):
    """Clusters of the embeddings by density, with noise; a hierarchy over neighbours, which SQL cannot express within reason."""
    return density.clusters(ad.table(spark, d, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


class MadeReplies:
    """Stands for a model: replies made from the items, by turns in a fence, as a list, broken off, and as an object; some rows are left out."""

    def ask(self, prompts: DataFrame) -> DataFrame:
        n = lambda x: F.char_length(x["text"])
        leaves, moods = F.lit([i.split("__")[-1] for i in PACK.ids()]), F.lit(["very_neg", " NEG ", "Neutral", "pos"])
        bit = lambda x, k: (n(x) % k == 0).cast("int")
        tag = lambda x: F.struct(
            x["conversation_id"].alias("conversation_id"), F.get(leaves, n(x) % len(PACK.ids())).alias("l5_id"), F.get(moods, n(x) % 4).alias("sentiment"), bit(x, 2).alias("churn_intent"),
            bit(x, 3).alias("financial_harm"), bit(x, 5).alias("safety_legal"), bit(x, 11).alias("repeat_contact"), bit(x, 13).alias("unresolved"), (n(x) % 10 / 10.0).alias("confidence"),
        )
        tags = F.to_json(F.transform(F.filter("items", lambda x: n(x) % 7 != 0), tag))
        whole = F.concat(F.lit('{"tags": '), tags, F.lit("}"))
        kind = F.col("batch") % 4
        reply = F.when(kind == 0, F.concat(F.lit("```json\n"), whole, F.lit("\n```"))).when(kind == 1, tags).when(kind == 2, F.substring(whole, 1, 40)).otherwise(whole)
        return prompts.select("batch", reply.alias("reply"))


_PART = f"('0x' || substr(md5(conversation_id), 1, 8))::BIGINT % (SELECT greatest(1, CAST(ceil(count(*) / {model_tagger.PART_ROWS}) AS BIGINT)) FROM c)"


@query(f"""WITH c AS (SELECT conv_id || '-' || turn AS conversation_id, coalesce(min(text), '') AS text FROM conversations WHERE role = 'user' AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
p AS (SELECT *, length(text) AS n, {_PART} AS part FROM c), b AS (SELECT *, (part * 4294967296 + (row_number() OVER (PARTITION BY part ORDER BY conversation_id, text) - 1) // 10) % 4 AS kind FROM p)
SELECT conversation_id, CASE WHEN ok THEN list_extract({PACK.ids()!r}, CAST(n % {len(PACK.ids())} AS INT) + 1) ELSE '{PACK.ids()[0]}' END AS l5_id,
  CASE WHEN ok THEN list_extract(['very_neg', 'neg', 'neutral', 'pos'], CAST(n % 4 AS INT) + 1) ELSE 'neg' END AS sentiment, CAST(ok AND n % 2 = 0 AS INT) AS churn_intent, CAST(ok AND n % 3 = 0 AS INT) AS financial_harm,
  CAST(ok AND n % 5 = 0 AS INT) AS safety_legal, CAST(ok AND n % 11 = 0 AS INT) AS repeat_contact, CAST(CASE WHEN ok THEN n % 13 = 0 ELSE true END AS INT) AS unresolved,
  CASE WHEN ok THEN round(n % 10 / 10.0::DOUBLE, 6) ELSE 0.0::DOUBLE END AS confidence, kind <> 2 AS cached
FROM (SELECT *, kind <> 2 AND n % 7 <> 0 AS ok FROM b)""")
def model_tags(spark, d):
    """Every user turn, tagged from replies in batches of ten: fenced, bare, as a list, broken off, with rows left out."""
    c = ad.table(spark, d, "conversations").where("role = 'user' and conv_id is not null and turn is not null").groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    c = c.select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("conversation_id"), "text")
    tagged, new = tagger.tag_conversations(c, PACK, model_tagger.ModelTagger(MadeReplies(), model_tagger.LOCAL_BATCH))
    cached = new.select("key", F.lit(True).alias("cached"))
    d = tagged.withColumn("key", tagger.cache_key(PACK.version)).join(cached, "key", "left").withColumn("cached", F.coalesce("cached", F.lit(False)))
    return d.select("conversation_id", "l5_id", "sentiment", *SIGNALS, F.round("confidence", 6).alias("confidence"), "cached")


def turns_store(spark: SparkSession, d: str) -> gr.Store:
    """All turns of the conversations as exemplars of their roles."""
    t = ad.table(spark, d, "conversations").where("conv_id is not null and turn is not null")
    t = t.groupBy("conv_id", "turn").agg(F.coalesce(F.min("text"), F.lit("")).alias("snippet"), F.coalesce(F.min("role"), F.lit("")).alias("l5_id"))
    key = F.concat(F.lit("exemplar:"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    props = F.to_json(F.struct(key.alias("conversation_id"), "l5_id", "snippet", (F.col("turn") % 5).cast("double").alias("severity")))
    nodes = t.select(key.alias("id"), F.lit("exemplar").alias("type"), props.alias("props"), F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("pack_version"), F.lit("0").alias("updated_at"))
    store, none = gr.Store(spark, shared_folder(spark)), gr.empty(spark)
    store.write(gr.Graph(nodes, none.edges, none.runs), base=0)
    return store


ASKED = "how can I learn to explain the water"
_ASKED = f"unnest({sorted(set(ASKED.lower().split()))!r})"


@query(f"""WITH t AS (SELECT 'exemplar:' || conv_id || '-' || turn AS id, coalesce(min(text), '') AS snippet, coalesce(min(role), '') AS l5_id, (turn % 5)::DOUBLE AS severity FROM conversations
  WHERE conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id, turn),
w AS (SELECT *, regexp_extract_all(translate(snippet, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9'']+') AS w FROM t), a AS (SELECT count(*) AS n, sum(len(w))::DOUBLE AS words FROM w),
q AS (SELECT {_ASKED} AS term), p AS (SELECT id, l5_id, severity, len(w) AS length, term, len(list_filter(w, lambda x: x = term)) AS tf FROM w, q),
df AS (SELECT term, count(*) AS df FROM p WHERE tf > 0 GROUP BY term),
s AS (SELECT id, l5_id, severity, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / (words / n)))) AS score FROM p JOIN df USING (term), a WHERE tf > 0 GROUP BY ALL)
SELECT id, l5_id, severity, round(score, 6) AS score FROM s ORDER BY round(score, 9) DESC, severity DESC, id LIMIT 20""")
def transcript_search(spark, d):
    """The twenty turns that match best, from the postings of the words asked for."""
    return search.Index(turns_store(spark, d)).build().search(ASKED, k=20).select("id", "l5_id", "severity", F.round("score", 6).alias("score"))
