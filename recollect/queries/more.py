"""Further queries: caches, unions of candidates, snapshots, receipts, gold rows, reader lines."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import dates, text
from recollect.operators import mutations, vectors
from recollect.plans import base
from recollect.plans.base import SQL_FACTS, SQL_ORDERS
from recollect.queries import search
from recollect.queries.registry import query


@query("scan_keyset", SQL_FACTS + " SELECT fact_id, kind FROM facts WHERE fact_id > '8' ORDER BY fact_id LIMIT 1200")
def scan_keyset(spark, sf):
    """The page of at most 1200 facts behind an id (a paging operator)."""
    return base.facts(spark, sf).where("fact_id > '8'").orderBy("fact_id").limit(1200).select("fact_id", "kind")


@query("sample_vectors", "SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT 100")
def sample_vectors(spark, sf):
    """The first 100 vectors by id (a sampling operator)."""
    return base.table(spark, sf, "embeddings").select("vec_id").orderBy("vec_id").limit(100)


@query("patch_facts", """WITH p AS (SELECT user_id, event_type, arg_max(value, struct_pack(ts, event_id)) AS value FROM events GROUP BY user_id, event_type)
SELECT c_custkey, c_acctbal, event_type, value FROM customer LEFT JOIN p ON c_custkey = user_id""")
def patch_facts(spark, sf):
    """Patches by id folded into rows, the latest of each field winning."""
    latest = base.table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    return base.table(spark, sf, "customer").join(latest, F.col("c_custkey") == F.col("user_id"), "left").select("c_custkey", "c_acctbal", "event_type", "value")


@query("emb_cache", SQL_FACTS + """, cache AS (SELECT DISTINCT sha256(text) AS k FROM facts WHERE doc_id < 'doc:5') SELECT kind, count(*) FILTER (WHERE c.k IS NOT NULL) AS hits, count(DISTINCT CASE WHEN c.k IS NULL THEN sha256(text) END) AS misses FROM facts LEFT JOIN cache c ON c.k = sha256(text) GROUP BY kind""")
def emb_cache(spark, sf):
    """Texts already encoded, and distinct ones that are not."""
    f = base.facts(spark, sf).withColumn("k", F.sha2("text", 256))
    cache = f.where("doc_id < 'doc:5'").select("k", F.lit(True).alias("hit")).distinct()
    return f.join(cache, "k", "left").groupBy("kind").agg(F.count_if(F.col("hit")).alias("hits"), F.countDistinct(F.when(F.col("hit").isNull(), F.col("k"))).alias("misses"))


@query("j_revive", SQL_ORDERS + " SELECT fact_id FROM order_facts WHERE superseded_by IN (SELECT CAST(fact_id AS VARCHAR) FROM order_facts WHERE value = 'P') AND value <> 'P'")
def j_revive(spark, sf):
    f = base.order_facts(spark, sf)
    gone = f.where("value = 'P'").select(F.col("fact_id").cast("string").alias("superseded_by"))
    return f.where("value <> 'P'").join(gone, "superseded_by", "left_semi").select("fact_id")


@query("mem_delete", SQL_FACTS + """, ids AS (SELECT fact_id FROM facts WHERE kind = 'atomic' AND doc_id = 'doc:2'), orphan AS (SELECT f.fact_id FROM facts f WHERE kind = 'verbatim' AND source_ref IN (SELECT source_ref FROM facts WHERE fact_id IN (SELECT fact_id FROM ids))
AND source_ref NOT IN (SELECT source_ref FROM facts WHERE kind = 'atomic' AND fact_id NOT IN (SELECT fact_id FROM ids)))
SELECT kind, count(*) AS n FROM facts WHERE fact_id NOT IN (SELECT fact_id FROM ids UNION SELECT fact_id FROM orphan) GROUP BY kind""")
def mem_delete(spark, sf):
    """Atomic facts deleted with the source turns that nothing else uses; what remains, by lane."""
    f = base.facts(spark, sf).withColumns({"superseded_by": F.lit(""), "valid_to": F.lit(None).cast("timestamp_ntz")})
    ids = f.where("kind = 'atomic' and doc_id = 'doc:2'").select("fact_id")
    every = ids.union(mutations.orphaned_sources(f, ids).select("fact_id"))
    return mutations.deleted(f, every).groupBy("kind").agg(F.count("*").alias("n"))


@query("forget", SQL_FACTS + " SELECT kind, count(*) AS n FROM facts WHERE NOT (doc_id = 'doc:1' AND time_bucket = '2024-02') GROUP BY kind")
def forget(spark, sf):
    return base.facts(spark, sf).where("not (doc_id = 'doc:1' and time_bucket = '2024-02')").groupBy("kind").agg(F.count("*").alias("n"))


@query("j_goldmap", SQL_FACTS + """, gold AS (SELECT conv_id, turn, 'session:' || conv_id || '/turn:' || (turn + conv_id % 2 * 100) AS ref, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm FROM conversations WHERE role = 'user'),
v AS (SELECT source_ref, min(doc_id) AS doc_id FROM facts WHERE kind = 'verbatim' GROUP BY source_ref), n AS (SELECT trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS norm, arg_max(doc_id, pos) AS doc_id FROM facts WHERE kind = 'verbatim' GROUP BY 1)
SELECT g.conv_id, g.turn, coalesce(v.doc_id, n.doc_id) AS bucket FROM gold g LEFT JOIN v ON v.source_ref = g.ref LEFT JOIN n ON n.norm = g.norm""")
def j_goldmap(spark, sf):
    """Gold turns to stored rows by reference, else by normalised text (the later duplicate wins)."""
    norm = text.squeeze(F.lower("text"))
    gold = base.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(F.lit("session:"), F.col("conv_id"), F.lit("/turn:"), F.col("turn") + F.col("conv_id") % 2 * 100).alias("source_ref"), norm.alias("norm"))
    v = base.facts(spark, sf).where("kind = 'verbatim'")
    by_ref = v.groupBy("source_ref").agg(F.min("doc_id").alias("one"))
    by_text = v.groupBy(norm.alias("norm")).agg(F.max_by("doc_id", "pos").alias("two"))
    return gold.join(by_ref, "source_ref", "left").join(by_text, "norm", "left").select("conv_id", "turn", F.coalesce("one", "two").alias("bucket"))


@query("j_interleave", search.SQL_BM25 + """, lists AS (SELECT query_id, id, place, 0 AS l FROM lex UNION ALL SELECT query_id, id + 1, place, 1 FROM lex), f AS (SELECT query_id, id, min(place * 2 + l) AS spot FROM lists GROUP BY query_id, id)
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY spot) AS place FROM f""")
def j_interleave(spark, sf):
    """Ranked lists zipped rank by rank, first occurrences kept."""
    lex = search._lexical(spark, sf)
    lists = lex.select("query_id", "id", (F.col("place") * 2).alias("at")).union(lex.select("query_id", F.col("id") + 1, F.col("place") * 2 + 1))
    first = lists.groupBy("query_id", "id").agg(F.min("at").alias("at"))
    return first.select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("at")).cast("long").alias("place"))


@query("posthoc_buckets", search.SQL_NEAR + " SELECT query_id, bucket, count(*) AS hits FROM near GROUP BY query_id, bucket")
def posthoc_buckets(spark, sf):
    labels = search._vectors(spark, sf).select("id", "bucket")
    return search._near(spark, sf).join(labels, "id").groupBy("query_id", "bucket").agg(F.count("*").alias("hits"))


@query("maxpool", search.SQL_NEAR + """, m AS (SELECT query_id // 60 AS question, id, max(cosine) AS cosine FROM near GROUP BY 1, 2)
SELECT question, id, cosine FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY cosine DESC, id) AS k FROM m) WHERE k <= 10""")
def maxpool(spark, sf):
    """A question's sub-questions pooled by their best score."""
    pooled = search._near(spark, sf).groupBy(F.floor(F.col("query_id") / 60).alias("question"), "id").agg(F.max("cosine").alias("cosine"))
    return pooled.withColumn("k", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("cosine"), "id"))).where("k <= 10").drop("k")


@query("proto_route", """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector, label * 2 + vec_id % 2 AS bucket FROM embeddings), parts AS (SELECT bucket, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v),
packed AS (SELECT bucket, list(m ORDER BY i) AS c FROM (SELECT bucket, i, avg(x) AS m FROM parts GROUP BY bucket, i) GROUP BY bucket), cents AS (SELECT bucket, list_transform(c, lambda x: x / (sqrt(list_inner_product(c, c)) + 1e-8)) AS centroid FROM packed)
SELECT v.id AS query_id, c.bucket // 2 AS bucket, max(round(list_inner_product(v.vector, c.centroid), 6)) AS similarity FROM v, cents c GROUP BY v.id, c.bucket // 2""")
def proto_route(spark, sf):
    """Buckets scored by the best of their sub-centroids."""
    v = search._vectors(spark, sf)
    subs = vectors.centroids(v.select("vector", (F.col("bucket") * 2 + F.col("id") % 2).alias("bucket")))
    routed = vectors.route(v.select(F.col("id").alias("query_id"), "vector"), subs)
    return routed.groupBy("query_id", F.floor(F.col("bucket") / 2).alias("bucket")).agg(F.max("similarity").alias("similarity"))


@query("recluster", search._lloyd_sql(8, 2) .replace(" SELECT id, bucket, s AS similarity FROM a2", " SELECT e.label AS old, a2.bucket AS new, count(*) AS n, 1 AS version FROM a2 JOIN embeddings e ON e.vec_id = a2.id GROUP BY e.label, a2.bucket"))
def recluster(spark, sf):
    """New buckets of all vectors as the next version, against the old ones."""
    v = search._vectors(spark, sf)
    new = vectors.lloyd(v.select("id", "vector"), 8, 2)[0].select("id", F.col("bucket").cast("long").alias("new"))
    return new.join(v.select("id", F.col("bucket").alias("old")), "id").groupBy("old", "new").agg(F.count("*").alias("n")).withColumn("version", F.lit(1))


@query("lane_union", SQL_FACTS + """ SELECT source_session, fact_id, CASE kind WHEN 'verbatim' THEN 0 ELSE 1 END AS lane_no FROM facts WHERE kind = 'verbatim' OR (kind = 'atomic' AND CAST(substr(source_session, 9) AS BIGINT) % 4 <> 0)""")
def lane_union(spark, sf):
    """Candidates of both lanes; sessions asked for advice (here every fourth) leave the atomic one out."""
    f = base.facts(spark, sf)
    advice = F.substring("source_session", 9, 20).cast("long") % 4 == 0
    lane = lambda n, rows: rows.select("source_session", "fact_id", F.lit(n).alias("lane_no"))
    return lane(0, f.where("kind = 'verbatim'")).unionByName(lane(1, f.where((F.col("kind") == "atomic") & ~advice)))


@query("axis_union", SQL_FACTS + " SELECT DISTINCT fact_id FROM facts WHERE doc_id = 'doc:1' OR list_contains(entities, 'the') OR time_bucket = '2024-03'")
def axis_union(spark, sf):
    """Topic, entity and time postings united."""
    f = base.facts(spark, sf)
    entity = f.select("fact_id", F.explode("entities").alias("e")).where("e = 'the'").select("fact_id")
    return f.where("doc_id = 'doc:1'").select("fact_id").union(entity).union(f.where("time_bucket = '2024-03'").select("fact_id")).distinct()


@query("multiaxis_build", SQL_FACTS + ", e AS (SELECT unnest(entities) AS key, fact_id FROM facts) SELECT 'entity' AS axis, key, count(*) AS postings FROM e GROUP BY key UNION ALL SELECT 'time', time_bucket, count(*) FROM facts GROUP BY time_bucket")
def multiaxis_build(spark, sf):
    f = base.facts(spark, sf)
    entity = f.select(F.lit("entity").alias("axis"), F.explode(text.entities(F.col("text"))).alias("key"))
    return entity.union(f.select(F.lit("time"), "time_bucket")).groupBy("axis", "key").agg(F.count("*").alias("postings"))


@query("entity_rank", SQL_FACTS + """, m AS (SELECT doc_id, fact_id, len(list_intersect(entities, ['the', 'in', 'mother'])) AS hits, length(text) AS size, pos FROM facts WHERE kind = 'verbatim')
SELECT doc_id, fact_id, round(1.0::DOUBLE / (59 + row_number() OVER (PARTITION BY doc_id ORDER BY hits DESC, pos)) + 1.0::DOUBLE / (59 + row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, pos)), 9) AS fused FROM m""")
def entity_rank(spark, sf):
    """Fusion of the number of matched entities with another signal (here the length)."""
    m = base.facts(spark, sf).where("kind = 'verbatim'").select("doc_id", "fact_id", "pos", F.size(F.array_intersect("entities", F.array(*map(F.lit, ("the", "in", "mother"))))).alias("hits"), F.length("text").alias("size"))
    return vectors.reciprocal_ranks(m.withColumn("query_id", F.col("doc_id")), ["hits", "size"], key="pos").select("doc_id", "fact_id", "fused")


@query("index_snapshot", SQL_FACTS + " SELECT fact_id, doc_id AS bucket, time_bucket, len(entities) AS n_entities, md5(substr(text, 1, 200)) AS head FROM facts")
def index_snapshot(spark, sf):
    return base.facts(spark, sf).select("fact_id", F.col("doc_id").alias("bucket"), "time_bucket", F.size("entities").cast("long").alias("n_entities"), F.md5(F.substring("text", 1, 200)).alias("head"))


@query("receipt", SQL_FACTS + """ SELECT source_session, count(*) AS lines, (sum(length('[' || coalesce(strftime(ts, '%Y-%m-%d'), 'unknown-date') || '] ' || text)) + count(*) - 1 + 20) // 4 AS tokens FROM facts WHERE kind = 'verbatim' GROUP BY source_session""")
def receipt(spark, sf):
    """Estimated reader tokens of a session's evidence lines and a question of 20 characters."""
    line = F.concat(F.lit("["), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown-date")), F.lit("] "), "text")
    return base.facts(spark, sf).where("kind = 'verbatim'").groupBy("source_session").agg(F.count("*").alias("lines"), F.floor((F.sum(F.length(line)) + F.count("*") - 1 + 20) / 4).alias("tokens"))


@query("gold_flags", """WITH t AS (SELECT conv_id, turn, role = 'assistant' AND length(text) > 1000 AS needle, conv_id % 7 = 0 AS answer FROM conversations)
SELECT conv_id, turn, needle, needle OR answer AS gold, bool_or(needle OR answer) OVER (PARTITION BY conv_id) AS gold_session FROM t""")
def gold_flags(spark, sf):
    t = base.table(spark, sf, "conversations").select("conv_id", "turn", ((F.col("role") == "assistant") & (F.length("text") > 1000)).alias("needle"), (F.col("conv_id") % 7 == 0).alias("answer"))
    gold = F.col("needle") | F.col("answer")
    return t.select("conv_id", "turn", "needle", gold.alias("gold"), F.bool_or(gold).over(Window.partitionBy("conv_id")).alias("gold_session"))


# Question types and the ability they test.
ABILITIES = {"single-session-user": "info_extraction", "single-session-assistant": "info_extraction", "single-session-preference": "info_extraction", "multi-session": "multi_session", "temporal-reasoning": "temporal", "knowledge-update": "knowledge_update"}


@query("ability_map", f"WITH q AS (SELECT c_custkey, {base.sql_list(ABILITIES)}[c_custkey % {len(ABILITIES)} + 1] AS type, CAST(c_custkey AS VARCHAR) || CASE WHEN c_custkey % 5 = 0 THEN '_abs' ELSE '' END AS id FROM customer) SELECT id, CASE WHEN ends_with(id, '_abs') THEN 'abstention' ELSE map({base.sql_list(ABILITIES)}, {base.sql_list(ABILITIES.values())})[type] END AS ability FROM q")
def ability_map(spark, sf):
    kinds = F.create_map(*[F.lit(x) for kv in ABILITIES.items() for x in kv])
    kind = F.try_element_at(F.array(*map(F.lit, ABILITIES)), (F.col("c_custkey") % len(ABILITIES) + 1).cast("int"))
    rows = base.table(spark, sf, "customer").select(kind.alias("type"), F.concat(F.col("c_custkey").cast("string"), F.when(F.col("c_custkey") % 5 == 0, "_abs").otherwise("")).alias("id"))
    return rows.select("id", F.when(F.endswith("id", F.lit("_abs")), "abstention").otherwise(F.try_element_at(kinds, "type")).alias("ability"))


@query("facts_block", SQL_FACTS + """ SELECT source_session, string_agg('- [' || coalesce(strftime(ts, '%Y-%m-%d'), 'unknown-date') || '] ' || substr(replace(text, chr(10), ' '), 1, 180), chr(10) ORDER BY pos) AS block FROM facts WHERE kind = 'verbatim' GROUP BY source_session""")
def facts_block(spark, sf):
    line = F.concat(F.lit("- ["), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown-date")), F.lit("] "), F.substring(F.replace("text", F.lit("\n"), F.lit(" ")), 1, 180))
    rows = base.facts(spark, sf).where("kind = 'verbatim'").groupBy("source_session").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return rows.select("source_session", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("block"))


@query("ledger_append", SQL_FACTS + ", seen AS (SELECT DISTINCT source_ref FROM facts WHERE kind = 'atomic') SELECT fact_id, source_ref FROM facts WHERE kind = 'verbatim' AND source_ref NOT IN (SELECT source_ref FROM seen)")
def ledger_append(spark, sf):
    """Evidence whose reference the ledger doesn't have yet."""
    f = base.facts(spark, sf)
    return f.where("kind = 'verbatim'").join(f.where("kind = 'atomic'").select("source_ref").distinct(), "source_ref", "left_anti").select("fact_id", "source_ref")


@query("knowledge_ctx", SQL_FACTS + " SELECT fact_id, pos FROM facts ORDER BY pos DESC, fact_id LIMIT 40")
def knowledge_ctx(spark, sf):
    """The last 40 evidence rows (a top-k report)."""
    return base.facts(spark, sf).orderBy(F.desc("pos"), "fact_id").limit(40).select("fact_id", "pos")


@query("verbatim_timeline", SQL_FACTS + """, h AS (SELECT doc_id, pos, ts, substr(text, 1, 220) AS head FROM facts WHERE kind = 'verbatim'), d AS (SELECT doc_id, head, min(pos) AS pos, arg_min(strftime(ts, '%Y-%m-%d'), pos) AS day FROM h WHERE ts IS NOT NULL GROUP BY doc_id, head)
SELECT doc_id, pos, day || ': "' || head || '"' AS quote FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM d) WHERE k <= 80""")
def verbatim_timeline(spark, sf):
    """Dated quotes of a document's first 80 distinct heads (a top-k report)."""
    h = base.facts(spark, sf).where("kind = 'verbatim' and ts is not null").select("doc_id", "pos", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.substring("text", 1, 220).alias("head"))
    d = h.groupBy("doc_id", "head").agg(F.min("pos").alias("pos"), F.min_by("day", "pos").alias("day"))
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
    return d.withColumn("k", k).where("k <= 80").select("doc_id", "pos", F.concat("day", F.lit(': "'), "head", F.lit('"')).alias("quote"))


@query("warm_jobs", "SELECT conv_id, sha1('ingest' || chr(31) || conv_id || chr(31) || string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS key, sum(length(text)) AS chars FROM conversations GROUP BY conv_id")
def warm_jobs(spark, sf):
    """A job per session, keyed by its number and whole transcript."""
    lines = base.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.concat("role", F.lit(": "), "text").alias("line"))
    whole = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "line"))).alias("t"), F.sum(F.length("text")).alias("chars"))
    transcript = F.array_join(F.transform("t", lambda x: x["line"]), "\n")
    return whole.select("conv_id", F.sha1(F.concat_ws("\x1f", F.lit("ingest"), F.col("conv_id").cast("string"), transcript)).alias("key"), "chars")


@query("fallback_estimate", "SELECT conv_id, sum(length(text)) // 4 AS prompt_tokens FROM conversations GROUP BY conv_id")
def fallback_estimate(spark, sf):
    return base.table(spark, sf, "conversations").groupBy("conv_id").agg(F.floor(F.sum(F.length("text")) / 4).alias("prompt_tokens"))


@query("ordering_reader_sort", """WITH l AS (SELECT c_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') || ' | ' || o_orderpriority AS line FROM customer JOIN orders ON c_custkey = o_custkey)
SELECT c_custkey, string_agg(split_part(line, ' | ', 2), ', ' ORDER BY split_part(line, ' | ', 1), o_orderkey) AS ordered FROM l GROUP BY c_custkey""")
def ordering_reader_sort(spark, sf):
    """``date | text`` lines in order of their dates."""
    line = F.concat(F.date_format(F.col("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd"), F.lit(" | "), "o_orderpriority")
    rows = base.table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.split(line, r" \| ").alias("p"))
    sorted_ = rows.groupBy("c_custkey").agg(F.array_sort(F.collect_list(F.struct(F.get("p", F.lit(0)).alias("d"), "o_orderkey", F.get("p", F.lit(1)).alias("t")))).alias("l"))
    return sorted_.select("c_custkey", F.array_join(F.transform("l", lambda x: x["t"]), ", ").alias("ordered"))


@query("spoken_dates", "SELECT event_id, strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%S') AS spoken, strftime(ts, '%Y-%m-%dT00:00:00') AS anchor FROM events")
def spoken_dates(spark, sf):
    """Dates as conversations write them: a time on a day, and a month-day-year anchor."""
    ts = F.col("ts").cast("timestamp_ntz")
    spoken = F.concat(F.lower(F.date_format(ts, "h:mm a")), F.lit(" on "), F.date_format(ts, "d MMMM, yyyy"))
    return base.table(spark, sf, "events").select("event_id", dates.iso_seconds(dates.spoken(spoken)).alias("spoken"), dates.iso_seconds(dates.anchor(F.date_format(ts, "MMMM-d-yyyy"))).alias("anchor"))


@query("recipe_check", "SELECT p_brand, round(avg(p_retailprice), 4) AS measured, abs(avg(p_retailprice) / 1000 - 1) <= 0.03 AS within FROM part GROUP BY p_brand")
def recipe_check(spark, sf):
    """A measured mean against a published value and its tolerance."""
    mean = F.avg("p_retailprice")
    return base.table(spark, sf, "part").groupBy("p_brand").agg(F.round(mean, 4).alias("measured"), (F.abs(mean / 1000 - 1) <= 0.03).alias("within"))
