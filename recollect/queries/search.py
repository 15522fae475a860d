"""Queries of vector and lexical search, routing, fusion and clustering."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import text
from recollect.operators import lexical, validity, vectors
from recollect.plans import base
from recollect.plans.base import SQL_FACTS
from recollect.queries.registry import query


def _vectors(spark, sf):
    return base.table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.col("label").alias("bucket"))


def _queries(spark, sf):
    return _vectors(spark, sf).where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")


SQL_CENTS = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label AS bucket FROM embeddings),
parts AS (SELECT bucket, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v),
means AS (SELECT bucket, i, avg(x) AS m, count(*) AS n FROM parts GROUP BY bucket, i),
packed AS (SELECT bucket, max(n) AS size, list(m ORDER BY i) AS c FROM means GROUP BY bucket),
cents AS (SELECT bucket, size, list_transform(c, lambda x: x / (sqrt(list_inner_product(c, c)) + 1e-8)) AS centroid FROM packed)"""
SQL_ROUTED = SQL_CENTS + """,
q AS (SELECT id AS query_id, vector FROM v),
sims AS (SELECT query_id, bucket, size, round(list_inner_product(vector, centroid), 6) AS similarity FROM q, cents),
wts AS (SELECT *, exp((similarity - max(similarity) OVER (PARTITION BY query_id)) / 0.1) AS w FROM sims),
routed AS (SELECT query_id, bucket, size, similarity, round(w / sum(w) OVER (PARTITION BY query_id), 6) AS probability FROM wts)"""


def sql_opened(budget: float, where: str = "true") -> str:
    return f"""opened AS (SELECT query_id, bucket, size, similarity, probability, place FROM (SELECT *, row_number() OVER w AS place, sum(size) OVER w - size AS before,
greatest(1, ceil({budget}::DOUBLE * sum(size) OVER (PARTITION BY query_id))) AS target FROM routed WHERE {where} WINDOW w AS (PARTITION BY query_id ORDER BY similarity DESC, bucket ROWS UNBOUNDED PRECEDING)) WHERE before < target)"""


def _routed(spark, sf):
    v = _vectors(spark, sf)
    return vectors.route(v.select(F.col("id").alias("query_id"), "vector"), vectors.centroids(v))


@query("centroid_mean", SQL_CENTS + " SELECT bucket, i, round(c, 6) AS value FROM (SELECT bucket, unnest(centroid) AS c, generate_subscripts(centroid, 1) AS i FROM cents)")
def centroid_mean(spark, sf):
    return vectors.centroids(_vectors(spark, sf)).select("bucket", F.posexplode("centroid").alias("k", "c")).select("bucket", (F.col("k") + 1).cast("long").alias("i"), F.round("c", 6).alias("value"))


@query("bucket_sizes", "SELECT label AS bucket, count(*) AS size FROM embeddings GROUP BY label")
def bucket_sizes(spark, sf):
    return _vectors(spark, sf).groupBy("bucket").agg(F.count("*").alias("size"))


@query("route_prob", SQL_ROUTED + " SELECT query_id, bucket, similarity, probability FROM routed")
def route_prob(spark, sf):
    return _routed(spark, sf).select("query_id", "bucket", "similarity", "probability")


@query("route_budget", SQL_ROUTED + ",\n" + sql_opened(0.3) + " SELECT query_id, bucket, place FROM opened")
def route_budget(spark, sf):
    return vectors.opened(_routed(spark, sf), 0.3).select("query_id", "bucket", F.col("place").cast("long").alias("place"))


@query("exclude_buckets", SQL_ROUTED + ",\n" + sql_opened(0.3, "bucket NOT IN (0, 1)") + " SELECT query_id, bucket, place, probability FROM opened")
def exclude_buckets(spark, sf):
    return vectors.opened(_routed(spark, sf), 0.3, (0, 1)).select("query_id", "bucket", F.col("place").cast("long").alias("place"), "probability")


@query("scan_frac", SQL_ROUTED + ",\n" + sql_opened(0.3) + " SELECT query_id, round(sum(size) / (SELECT count(*) FROM v), 6) AS scan_frac, count(*) AS buckets FROM opened GROUP BY query_id")
def scan_frac(spark, sf):
    n = _vectors(spark, sf).agg(F.count("*").alias("n"))
    return vectors.opened(_routed(spark, sf), 0.3).groupBy("query_id").agg(F.sum("size").alias("s"), F.count("*").alias("buckets")).join(F.broadcast(n), F.lit(True)).select("query_id", F.round(F.col("s") / F.col("n"), 6).alias("scan_frac"), "buckets")


@query("mean_scan", SQL_ROUTED + ",\n" + sql_opened(0.3) + """, f AS (SELECT query_id, sum(size) / (SELECT count(*) FROM v) AS x FROM opened GROUP BY query_id)
SELECT round(avg(x), 6) AS mean, round(min(x), 6) AS least, round(max(x), 6) AS most, count(*) AS queries FROM f""")
def mean_scan(spark, sf):
    return scan_frac(spark, sf).agg(F.round(F.avg("scan_frac"), 6).alias("mean"), F.min("scan_frac").alias("least"), F.max("scan_frac").alias("most"), F.count("*").alias("queries"))


@query("j_members", SQL_ROUTED + ",\n" + sql_opened(0.1) + " SELECT o.query_id, count(*) AS members, min(v.id) AS first_id, max(v.id) AS last_id FROM opened o JOIN v ON o.bucket = v.bucket GROUP BY o.query_id")
def j_members(spark, sf):
    return vectors.opened(_routed(spark, sf), 0.1).select("query_id", "bucket").join(_vectors(spark, sf), "bucket").groupBy("query_id").agg(F.count("*").alias("members"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query("j_assign", SQL_CENTS + " SELECT id, bucket, similarity FROM (SELECT v.id, c.bucket, round(list_inner_product(v.vector, c.centroid), 6) AS similarity, row_number() OVER (PARTITION BY v.id ORDER BY round(list_inner_product(v.vector, c.centroid), 6) DESC, c.bucket) AS k FROM v, cents c) WHERE k = 1")
def j_assign(spark, sf):
    v = _vectors(spark, sf)
    return vectors.assigned(v, vectors.centroids(v))


SQL_NEAR = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label AS bucket FROM embeddings),
near AS (SELECT * FROM (SELECT q.id AS query_id, v.id, v.bucket, q.bucket AS own, round(list_inner_product(q.vector, v.vector), 6) AS cosine, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.vector, v.vector), 6) DESC, v.id) AS place
FROM v, (SELECT * FROM v WHERE id % 20 = 0) q) WHERE place <= 20)"""


def _near(spark, sf, k=20):
    return vectors.dense_topk(_vectors(spark, sf), _queries(spark, sf), k).withColumn("place", F.col("place").cast("long"))


@query("dense_topk", SQL_NEAR + " SELECT query_id, id, cosine, place FROM near")
def dense_topk(spark, sf):
    return _near(spark, sf)


@query("rerank_cap", SQL_NEAR + " SELECT query_id, id, place FROM near WHERE place <= 5")
def rerank_cap(spark, sf):
    return _near(spark, sf, 5).select("query_id", "id", "place")


SQL_POOL = SQL_NEAR + ", pool AS (SELECT *, (id * 7919) % 101 AS utility FROM near)"


def _pool(spark, sf):
    return _near(spark, sf).withColumn("utility", F.col("id") * 7919 % 101)


@query("rrf", SQL_POOL + " SELECT query_id, id, round(1.0::DOUBLE / (60 + place - 1) + 1.0::DOUBLE / (60 + row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, id) - 1), 9) AS fused FROM pool")
def rrf(spark, sf):
    return vectors.reciprocal_ranks(_pool(spark, sf), ["cosine", "utility"]).select("query_id", "id", "fused")


@query("explain", SQL_POOL + " SELECT query_id, id, utility, cosine, k AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY utility DESC, id) AS k FROM pool) WHERE k <= 5")
def explain(spark, sf):
    w = Window.partitionBy("query_id").orderBy(F.desc("utility"), "id")
    return _pool(spark, sf).withColumn("place", F.row_number().over(w).cast("long")).where("place <= 5").select("query_id", "id", "utility", "cosine", "place")


SQL_HOPS = SQL_NEAR + """, far AS (SELECT * FROM (SELECT q.id AS query_id, v.id, round(list_inner_product(q.vector, v.vector), 6) AS cosine, row_number() OVER (PARTITION BY q.id ORDER BY round(list_inner_product(q.vector, v.vector), 6) DESC, v.id) AS place
FROM v, (SELECT * FROM v WHERE id IN (SELECT id FROM near)) q) WHERE place <= 20)"""


@query("multihop_max", SQL_HOPS + """, hop AS (SELECT a.query_id, b.id, a.cosine * b.cosine AS c FROM near a JOIN far b ON a.id = b.query_id UNION ALL SELECT query_id, id, cosine FROM near)
SELECT query_id, id, round(max(c), 6) AS cosine FROM hop GROUP BY query_id, id""")
def multihop_max(spark, sf):
    """The pool of two hops over all vectors: what the first hop's hits lead to, each at its best score."""
    v = _vectors(spark, sf)
    near = _near(spark, sf).select("query_id", "id", "cosine")
    bridges = near.select("id").distinct().join(v, "id").select(F.col("id").alias("query_id"), "vector")
    far = vectors.dense_topk(v, bridges, 20).select(F.col("query_id").alias("id"), F.col("id").alias("next"), F.col("cosine").alias("then"))
    second = near.join(far, "id").select("query_id", F.col("next").alias("id"), (F.col("cosine") * F.col("then")).alias("cosine"))
    return second.union(near).groupBy("query_id", "id").agg(F.round(F.max("cosine"), 6).alias("cosine"))


@query("recall_at_k", SQL_NEAR + """, gold AS (SELECT bucket, count(*) AS n FROM v GROUP BY bucket)
SELECT k, round(avg(100.0::DOUBLE * hits / n), 6) AS recall FROM (SELECT near.query_id, kk.k, any_value(g.n) AS n, count(*) FILTER (WHERE near.bucket = near.own AND place <= kk.k) AS hits
FROM near JOIN gold g ON near.own = g.bucket, (VALUES (2), (5)) kk(k) GROUP BY near.query_id, kk.k) GROUP BY k""")
def recall_at_k(spark, sf):
    v = _vectors(spark, sf)
    labels = v.select("id", "bucket")
    gold = v.groupBy("bucket").agg(F.count("*").alias("n"))
    near = _near(spark, sf).join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("bucket").alias("own")), "query_id").join(gold.withColumnRenamed("bucket", "own"), "own")
    per = near.select("*", F.explode(F.array(F.lit(2), F.lit(5))).alias("k")).groupBy("query_id", "k").agg(F.max("n").alias("n"), F.count_if((F.col("bucket") == F.col("own")) & (F.col("place") <= F.col("k"))).alias("hits"))
    return per.groupBy("k").agg(F.round(F.avg(100.0 * F.col("hits") / F.col("n")), 6).alias("recall"))


@query("hit_mrr", SQL_NEAR + """, firsts AS (SELECT query_id, min(place) FILTER (WHERE bucket = own AND id <> query_id) AS p FROM near GROUP BY query_id)
SELECT round(avg(CASE WHEN p <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS hit5, round(avg(coalesce(1.0::DOUBLE / p, 0)), 6) AS mrr, count(*) AS queries FROM firsts""")
def hit_mrr(spark, sf):
    labels = _vectors(spark, sf).select("id", "bucket")
    near = _near(spark, sf).join(labels, "id").join(labels.select(F.col("id").alias("query_id"), F.col("bucket").alias("own")), "query_id")
    firsts = near.groupBy("query_id").agg(F.min(F.when((F.col("bucket") == F.col("own")) & (F.col("id") != F.col("query_id")), F.col("place"))).alias("p"))
    return firsts.agg(F.round(F.avg(F.when(F.col("p") <= 5, 1.0).otherwise(0.0)), 6).alias("hit5"), F.round(F.avg(F.coalesce(1.0 / F.col("p"), F.lit(0.0))), 6).alias("mrr"), F.count("*").alias("queries"))


@query("coremem_core", SQL_ROUTED + ",\n" + sql_opened(0.3) + """ SELECT query_id, id, cosine FROM (SELECT o.query_id, v.id, round(list_inner_product(q.vector, v.vector), 6) AS cosine,
row_number() OVER (PARTITION BY o.query_id ORDER BY round(list_inner_product(q.vector, v.vector), 6) DESC, v.id) AS k FROM opened o JOIN q ON o.query_id = q.query_id JOIN v ON v.bucket = o.bucket WHERE o.query_id % 20 = 0) WHERE k <= 10""")
def coremem_core(spark, sf):
    """Route, open buckets under the budget, rank their members only: an equality join on the bucket."""
    v = _vectors(spark, sf)
    q = _queries(spark, sf)
    open_ = vectors.opened(vectors.route(q, vectors.centroids(v)), 0.3).select("query_id", "bucket").join(q, "query_id")
    pool = open_.withColumnRenamed("vector", "asked").join(v, "bucket").select("query_id", "id", F.round(vectors.dot(F.col("asked"), F.col("vector")), 6).alias("cosine"))
    w = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return pool.withColumn("k", F.row_number().over(w)).where("k <= 10").drop("k")


def _lloyd_sql(k: int, rounds: int) -> str:
    out = f"""WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
c0 AS (SELECT row_number() OVER (ORDER BY sha1(CAST(id AS VARCHAR))) - 1 AS bucket, 0 AS size, list_transform(vector, lambda x: x / (sqrt(list_inner_product(vector, vector)) + 1e-8)) AS centroid FROM (SELECT * FROM v ORDER BY sha1(CAST(id AS VARCHAR)) LIMIT {k}))"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS (SELECT id, bucket, s FROM (SELECT v.id, c.bucket, round(list_inner_product(v.vector, c.centroid), 6) AS s, row_number() OVER (PARTITION BY v.id ORDER BY round(list_inner_product(v.vector, c.centroid), 6) DESC, c.bucket) AS k FROM v, c{r} c) WHERE k = 1)"""
        if r < rounds:
            out += f""",
m{r} AS (SELECT bucket, list(m ORDER BY i) AS m, max(n) AS n FROM (SELECT bucket, i, avg(x) AS m, count(*) AS n FROM (SELECT a.bucket, unnest(v.vector) AS x, generate_subscripts(v.vector, 1) AS i FROM v JOIN a{r} a ON v.id = a.id) GROUP BY bucket, i) GROUP BY bucket),
c{r + 1} AS (SELECT c.bucket, coalesce(m.n, 0) AS size, CASE WHEN m.m IS NULL THEN c.centroid ELSE list_transform(m.m, lambda x: x / (sqrt(list_inner_product(m.m, m.m)) + 1e-8)) END AS centroid FROM c{r} c LEFT JOIN m{r} m ON c.bucket = m.bucket)"""
    return out + f" SELECT id, bucket, s AS similarity FROM a{rounds}"


@query("kmeans", _lloyd_sql(8, 3))
def kmeans(spark, sf):
    return vectors.lloyd(_vectors(spark, sf).select("id", "vector"), 8, 3)[0].select("id", F.col("bucket").cast("long").alias("bucket"), "similarity")


@query("encode_hash", """WITH tok AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS t FROM conversations),
s AS (SELECT conv_id, turn, ('0x' || substr(md5(t), 1, 4))::BIGINT % 256 AS i, sum(CASE WHEN ('0x' || substr(md5(t), 5, 1))::BIGINT < 8 THEN 1 ELSE -1 END) AS v FROM tok GROUP BY 1, 2, 3)
SELECT conv_id, turn, i, round(v / sqrt(CAST(sum(v * v) OVER (PARTITION BY conv_id, turn) AS DOUBLE)), 6) AS v FROM s WHERE v <> 0""")
def encode_hash(spark, sf):
    return vectors.hashed(base.table(spark, sf, "conversations"), ["conv_id", "turn"], text.tokens(F.col("text")))


@query("j_supersede", """WITH f AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS u, label, CASE WHEN vec_id % 5 <> 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(vec_id % 97 AS INTEGER)) END AS ts, vec_id % 3 AS tag, vec_id % 4 = 0 AS ch FROM embeddings),
p AS (SELECT n.vec_id AS new_id, n.ts AS nts, o.vec_id AS old_id, round(list_inner_product(n.u, o.u), 6) AS s, n.tag = o.tag AS shared, n.ch AND o.ch AS ch FROM f n JOIN f o ON n.label = o.label AND n.vec_id <> o.vec_id AND (n.ts IS NULL OR (o.ts IS NOT NULL AND n.ts > o.ts))),
b AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY s DESC, old_id DESC) AS k FROM p WHERE s >= 0.3 AND (s >= 0.45 OR shared OR ch)),
o AS (SELECT *, row_number() OVER (PARTITION BY old_id ORDER BY nts DESC NULLS LAST, CASE WHEN nts IS NULL THEN -new_id ELSE new_id END DESC) AS j FROM b WHERE k = 1)
SELECT old_id, new_id, strftime(nts, '%Y-%m-%d') AS valid_to FROM o WHERE j = 1""")
def j_supersede(spark, sf):
    ts = F.when(F.col("vec_id") % 5 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (F.col("vec_id") % 97).cast("int")).cast("timestamp_ntz"))
    facts = base.table(spark, sf, "embeddings").select(F.col("vec_id").alias("fact_id"), F.col("vec_id").alias("pos"), ts.alias("ts"), F.col("embedding").alias("unit"), F.array((F.col("vec_id") % 3).cast("string")).alias("tags"), (F.col("vec_id") % 4 == 0).alias("changing"), F.col("label").alias("bucket"))
    return validity.supersessions(facts, facts, 0.3, 0.45).withColumn("valid_to", F.date_format("valid_to", "yyyy-MM-dd"))


# -- lexical

SQL_BM25 = """WITH docs AS (SELECT doc_id AS id, text AS body FROM documents), qs AS (SELECT item_id AS query_id, text AS body FROM benchmark),
tok AS (SELECT id, unnest(CASE WHEN len(regexp_extract_all(lower(body), '[a-z0-9_]+')) > 0 THEN regexp_extract_all(lower(body), '[a-z0-9_]+') ELSE [''] END) AS token FROM docs),
tf AS (SELECT id, token, count(*) AS tf FROM tok GROUP BY id, token), posted AS (SELECT *, sum(tf) OVER (PARTITION BY id) AS dl FROM tf),
raw AS (SELECT token, ln((SELECT count(DISTINCT id) FROM tf) - count(*) + 0.5::DOUBLE) - ln(count(*) + 0.5::DOUBLE) AS idf FROM tf GROUP BY token),
w AS (SELECT token, CASE WHEN idf < 0 THEN 0.25::DOUBLE * (SELECT avg(idf) FROM raw) ELSE idf END AS idf FROM raw),
asked AS (SELECT query_id, token, count(*) AS qf FROM (SELECT query_id, unnest(regexp_extract_all(lower(body), '[a-z0-9_]+')) AS token FROM qs) GROUP BY query_id, token),
avgdl AS (SELECT avg(dl) AS m FROM (SELECT DISTINCT id, dl FROM posted)),
sc AS (SELECT query_id, id, round(sum(qf * idf * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / m))), 6) AS score FROM posted JOIN asked USING (token) JOIN w USING (token), avgdl GROUP BY query_id, id),
lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS place FROM sc WHERE score > 0) WHERE place <= 10)"""


def _lexical(spark, sf):
    docs = base.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("body"))
    asked = base.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("body"))
    return lexical.bm25(docs, asked, 10).withColumn("place", F.col("place").cast("long"))


@query("tokenize", "SELECT doc_id, len(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS n, md5(array_to_string(regexp_extract_all(lower(text), '[a-z0-9_]+'), ' ')) AS body FROM documents")
def tokenize(spark, sf):
    t = text.tokens(F.col("text"))
    return base.table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("body"))


@query("bm25", SQL_BM25 + " SELECT query_id, id, score, place FROM lex")
def bm25(spark, sf):
    return _lexical(spark, sf)


@query("lexical_union", SQL_BM25 + """, routed AS (SELECT b.item_id AS query_id, d.doc_id AS id, row_number() OVER (PARTITION BY b.item_id ORDER BY d.doc_id) AS r FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40)
SELECT coalesce(r.query_id, l.query_id) AS query_id, coalesce(r.id, l.id) AS id, coalesce(l.score, 0) AS score, r.id IS NULL AS added FROM routed r FULL JOIN lex l ON r.query_id = l.query_id AND r.id = l.id""")
def lexical_union(spark, sf):
    """Routed candidates keep their order, lexical ones that they miss are added."""
    d = base.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("k"))
    b = base.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("k"))
    routed = b.join(d, "k").select("query_id", "id", F.lit(True).alias("routed"))
    return routed.join(_lexical(spark, sf).select("query_id", "id", "score"), ["query_id", "id"], "full").select("query_id", "id", F.coalesce("score", F.lit(0.0)).alias("score"), F.col("routed").isNull().alias("added"))


@query("rrf_server", SQL_BM25 + """, other AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS place FROM (SELECT b.item_id AS query_id, d.doc_id AS id FROM benchmark b JOIN documents d ON d.doc_id % 40 = b.item_id % 40)),
lists AS (SELECT query_id, id, place FROM lex UNION ALL SELECT query_id, id, place FROM other WHERE place <= 10), f AS (SELECT query_id, id, round(sum(1.0::DOUBLE / (60 + place)), 9) AS fused FROM lists GROUP BY query_id, id)
SELECT query_id, id, fused, count(*) OVER (PARTITION BY query_id) - row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, id) AS as_cosine FROM f""")
def rrf_server(spark, sf):
    """Fusion of two separate lists by rank from 1; the fused place then stands in for the cosine."""
    d = base.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 40).alias("k"))
    b = base.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 40).alias("k"))
    other = b.join(d, "k").withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("id"))).where("place <= 10").select("query_id", "id", "place")
    lists = _lexical(spark, sf).select("query_id", "id", "place").union(other)
    fused = lists.groupBy("query_id", "id").agg(F.round(F.sum(1.0 / (60 + F.col("place"))), 9).alias("fused"))
    own = Window.partitionBy("query_id")
    return fused.withColumn("as_cosine", F.count("*").over(own) - F.row_number().over(own.orderBy(F.desc("fused"), "id")))


_CONTENT = "list_distinct(list_filter(regexp_extract_all(lower({0}), '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT list_contains(" + base.sql_list(text.TURN_STOPWORDS) + ", w)))"


@query("turn_match", SQL_FACTS + f""", ft AS (SELECT fact_id, source_session AS session, unnest({_CONTENT.format('text')}) AS token FROM facts WHERE kind = 'atomic'),
tt AS (SELECT 'session:' || conv_id AS session, turn, unnest({_CONTENT.format('text')}) AS token FROM conversations), rare AS (SELECT *, count(*) OVER (PARTITION BY session, token) AS df FROM tt),
sc AS (SELECT fact_id, turn, round(sum(1.0::DOUBLE / df), 6) AS score FROM ft JOIN rare USING (session, token) GROUP BY fact_id, turn)
SELECT fact_id, turn, score FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY score DESC, turn) AS k FROM sc) WHERE k = 1""")
def turn_match(spark, sf):
    facts = base.facts(spark, sf).where("kind = 'atomic'").select("fact_id", F.col("source_session").alias("session"), F.col("text").alias("body"))
    turns = base.table(spark, sf, "conversations").select(F.concat(F.lit("session:"), F.col("conv_id")).alias("session"), "turn", F.col("text").alias("body"))
    return lexical.matched_turns(facts, turns)


@query("utility_score", SQL_FACTS + """ SELECT f.fact_id, c.turn, len(list_intersect(string_split(lower(f.text), ' '), string_split(lower(c.text), ' '))) AS utility
FROM facts f JOIN conversations c ON f.source_session = 'session:' || c.conv_id WHERE f.kind = 'atomic'""")
def utility_score(spark, sf):
    """The default reranker: shared lower-cased words of a fact and each turn of its session."""
    facts = base.facts(spark, sf).where("kind = 'atomic'").select("fact_id", "source_session", F.col("text").alias("body"))
    turns = base.table(spark, sf, "conversations").select(F.concat(F.lit("session:"), F.col("conv_id")).alias("source_session"), "turn", "text")
    split = lambda c: F.split(F.lower(c), " ")
    return facts.join(turns, "source_session").select("fact_id", "turn", F.size(F.array_intersect(split(F.col("body")), split(F.col("text")))).cast("long").alias("utility"))
