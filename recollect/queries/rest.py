"""Queries of the store's smaller operators, of replies and gold rows, of routing indexes and lanes."""

from __future__ import annotations

from pyspark.sql import functions as F

from recollect.functions import parsing, routing, text
from recollect.operators import mutations, vectors
from recollect.plans import base
from recollect.plans.base import SQL_FACTS, SQL_ORDERS
from recollect.queries import scalars, search
from recollect.queries.registry import query

_q = scalars._q


# -- the store


@query("set_valid_to", SQL_ORDERS + " SELECT fact_id, strftime(CASE WHEN fact_id % 10 = 0 THEN TIMESTAMP '2024-05-01' ELSE valid_to END, '%Y-%m-%d') AS valid_to FROM order_facts")
def set_valid_to(spark, sf):
    """The end of some facts overridden, whatever it was."""
    f = base.order_facts(spark, sf)
    ids = f.where("fact_id % 10 = 0").select("fact_id", F.lit("2024-05-01").cast("timestamp_ntz").alias("until"))
    return mutations.valid_until(f, ids).select("fact_id", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


@query("get_fact", SQL_ORDERS + " SELECT fact_id, subject, value, superseded_by FROM order_facts WHERE fact_id = 7")
def get_fact(spark, sf):
    """One fact by its id (a point lookup)."""
    return base.order_facts(spark, sf).where("fact_id = 7").select("fact_id", "subject", "value", "superseded_by")


@query("list_rows_for_ids", SQL_FACTS + " SELECT fact_id, kind, text FROM facts WHERE fact_id IN (SELECT fact_id FROM facts WHERE kind = 'atomic')")
def list_rows_for_ids(spark, sf):
    """The small view of the rows that a table of ids names."""
    f = base.facts(spark, sf)
    return f.join(f.where("kind = 'atomic'").select("fact_id"), "fact_id", "left_semi").select("fact_id", "kind", "text")


@query("delete_doc", SQL_FACTS + " SELECT doc_id, kind, count(*) AS n FROM facts WHERE doc_id <> 'doc:3' GROUP BY doc_id, kind")
def delete_doc(spark, sf):
    """All facts of a document deleted; what remains, by document and lane."""
    f = base.facts(spark, sf).withColumns({"superseded_by": F.lit(""), "valid_to": F.lit(None).cast("timestamp_ntz")})
    return mutations.deleted(f, f.where("doc_id = 'doc:3'").select("fact_id")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))


@query("doc_registry", SQL_FACTS + " SELECT doc_id, count(DISTINCT source_session) AS sessions, count(*) AS facts, min(time_bucket) AS first_month FROM facts GROUP BY doc_id HAVING doc_id NOT IN ('doc:1', 'doc:4')")
def doc_registry(spark, sf):
    """The registered documents, without removed ones."""
    f = base.facts(spark, sf)
    gone = spark.createDataFrame([("doc:1",), ("doc:4",)], "doc_id string")
    listed = f.groupBy("doc_id").agg(F.countDistinct("source_session").alias("sessions"), F.count("*").alias("facts"), F.min("time_bucket").alias("first_month"))
    return listed.join(gone, "doc_id", "left_anti")


_KEY_OF = "CASE WHEN doc_id % 3 = 0 THEN 'seed:' || doc_id ELSE substr(sha1(coalesce(source, '') || chr(31) || '' || chr(31) || " + base.SQUEEZED.format("lower(body)") + "), 1, 32) END"


@query("ingest_facts", f"WITH b AS (SELECT doc_id, source, trim(regexp_replace(coalesce(text, ''), '\\s+', ' ', 'g')) AS body FROM documents) SELECT {_KEY_OF} AS fact_id, min(doc_id) AS pos FROM b WHERE body <> '' GROUP BY 1")
def ingest_facts(spark, sf):
    """Facts made elsewhere: a seed id or the content's identity, blank ones skipped, each once."""
    body = text.squeeze(F.coalesce("text", F.lit("")))
    rows = base.table(spark, sf, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("subject"), body.alias("body")).where("body <> ''")
    own = text.content_id(F.col("body"), F.col("subject"), F.lit(""), F.lit("atomic"))
    return rows.groupBy(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("seed:"), F.col("doc_id"))).otherwise(own).alias("fact_id")).agg(F.min("doc_id").alias("pos"))


_OLD = search.SQL_CENTS.replace("FROM embeddings)", "FROM embeddings WHERE vec_id % 2 = 0)", 1)


@query("upsert_db", _OLD + """, new AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings WHERE vec_id % 2 = 1)
SELECT id, bucket, similarity FROM (SELECT n.id, c.bucket, round(list_inner_product(n.vector, c.centroid), 6) AS similarity, row_number() OVER (PARTITION BY n.id ORDER BY round(list_inner_product(n.vector, c.centroid), 6) DESC, c.bucket) AS k FROM new n, cents c) WHERE k = 1""")
def upsert_db(spark, sf):
    """New rows, each labelled with the nearest centroid of what is stored."""
    v = search._vectors(spark, sf)
    stored, batch = v.where("id % 2 = 0"), v.where("id % 2 = 1")
    fresh = batch.join(stored.select("id"), "id", "left_anti")
    return vectors.assigned(fresh, vectors.centroids(stored))


@query("distill_cache", """WITH k AS (SELECT conv_id, sha1('v1' || chr(31) || 'subject' || chr(31) || string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text)) AS key, count(*) FILTER (WHERE role = 'user') AS found FROM conversations GROUP BY conv_id),
c AS (SELECT DISTINCT key FROM k WHERE conv_id % 2 = 0 AND found > 1) SELECT k.conv_id, k.key, c.key IS NOT NULL AS hit FROM k LEFT JOIN c USING (key)""")
def distill_cache(spark, sf):
    """Distilled sessions by version, subject and transcript; those that gave nothing much are not cached."""
    lines = base.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text", F.concat("role", F.lit(": "), "text").alias("line"))
    whole = lines.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", "line"))).alias("t"), F.count_if(F.col("role") == "user").alias("found"))
    k = whole.select("conv_id", "found", F.sha1(F.concat_ws("\x1f", F.lit("v1"), F.lit("subject"), F.array_join(F.transform("t", lambda x: x["line"]), "\n"))).alias("key"))
    cache = k.where("conv_id % 2 = 0 and found > 1").select("key", F.lit(True).alias("known")).distinct()
    return k.join(cache, "key", "left").select("conv_id", "key", F.col("known").isNotNull().alias("hit"))


@query("task_cache", "SELECT substr(sha256(lang || chr(31) || source || chr(31) || CAST(count(*) AS VARCHAR)), 1, 16) AS key, count(*) AS items, sum(length(text)) AS chars FROM documents GROUP BY lang, source")
def task_cache(spark, sf):
    """Built tasks addressed by their settings and size."""
    tasks = base.table(spark, sf, "documents").groupBy("lang", "source").agg(F.count("*").alias("items"), F.sum(F.length("text")).alias("chars"))
    key = F.substring(F.sha2(F.concat_ws("\x1f", "lang", "source", F.col("items").cast("string")), 256), 1, 16)
    return tasks.select(key.alias("key"), "items", "chars")


@query("bm25_cache", SQL_FACTS + " SELECT kind, count(*) FILTER (WHERE doc_id <> 'doc:9') AS held, count(*) AS now, count(*) FILTER (WHERE doc_id <> 'doc:9') <> count(*) AS rebuild FROM facts GROUP BY kind")
def bm25_cache(spark, sf):
    """A lane's lexical index is rebuilt when its number of rows is another than when it was built."""
    held, now = F.count_if(F.col("doc_id") != "doc:9"), F.count("*")
    return base.facts(spark, sf).groupBy("kind").agg(held.alias("held"), now.alias("now"), (held != now).alias("rebuild"))


_LANE_CENTS = """WITH v AS (SELECT vec_id % 2 AS lane, label AS bucket, CAST(embedding AS DOUBLE[]) AS vector FROM embeddings),
parts AS (SELECT lane, bucket, unnest(vector) AS x, generate_subscripts(vector, 1) AS i FROM v), means AS (SELECT lane, bucket, i, avg(x) AS m, count(*) AS n FROM parts GROUP BY ALL),
sq AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY lane, bucket)) + 1e-8 AS s FROM means)"""


@query("lane_partition", _LANE_CENTS + " SELECT lane, bucket, i, round(m / s, 6) AS value FROM sq")
def lane_partition(spark, sf):
    """Centroids of each lane's own partition."""
    v = search._vectors(spark, sf).select((F.col("id") % 2 * 1000000 + F.col("bucket")).alias("bucket"), "vector")
    parts = vectors.centroids(v).select("bucket", F.posexplode("centroid").alias("k", "c"))
    return parts.select(F.floor(F.col("bucket") / 1000000).alias("lane"), (F.col("bucket") % 1000000).cast("int").alias("bucket"), (F.col("k") + 1).cast("long").alias("i"), F.round("c", 6).alias("value"))


@query("partition_doc", "SELECT vec_id % 2 AS lane, label AS bucket, count(*) AS size, sum(count(*)) OVER (PARTITION BY vec_id % 2) AS n_at_build, 1 AS version FROM embeddings GROUP BY 1, 2")
def partition_doc(spark, sf):
    """What is stored of a partition beside its centroids: sizes, the lane's rows at build, a version."""
    sizes = base.table(spark, sf, "embeddings").groupBy((F.col("vec_id") % 2).alias("lane"), F.col("label").alias("bucket")).agg(F.count("*").alias("size"))
    return sizes.join(sizes.groupBy("lane").agg(F.sum("size").alias("n_at_build")), "lane").select("lane", "bucket", "size", "n_at_build", F.lit(1).alias("version"))


# -- lanes, routing


@query("lanes_for_method", "SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'atomic' WHEN 1 THEN 'verbatim' ELSE 'verbatim,atomic' END AS lanes FROM part")
def lanes_for_method(spark, sf):
    method = F.when(F.col("p_partkey") % 3 == 0, "coremem_atomic").when(F.col("p_partkey") % 3 == 1, "coremem").otherwise("coremem_union")
    return base.table(spark, sf, "part").select("p_partkey", F.array_join(routing.lanes(method), ",").alias("lanes"))


@query("union_perf_merge", search.SQL_ROUTED + ",\n" + search.sql_opened(0.3) + """, lanes AS (SELECT query_id, bucket % 2 AS lane, sum(size) AS scanned, sum(size) / (SELECT count(*) FROM v) AS frac FROM opened GROUP BY 1, 2)
SELECT query_id, sum(scanned) AS n_scanned, round(max(frac), 6) AS scan_frac, max(scanned) FILTER (WHERE lane = 0) AS lane0, max(scanned) FILTER (WHERE lane = 1) AS lane1 FROM lanes GROUP BY query_id""")
def union_perf_merge(spark, sf):
    """Traces of two lanes as one: costs add up, the larger scan fraction stays, each lane's own cost is kept."""
    n = search._vectors(spark, sf).count()
    lanes = vectors.opened(search._routed(spark, sf), 0.3).groupBy("query_id", (F.col("bucket") % 2).alias("lane")).agg(F.sum("size").alias("scanned"))
    own = lambda k: F.max(F.when(F.col("lane") == k, F.col("scanned")))
    return lanes.groupBy("query_id").agg(F.sum("scanned").alias("n_scanned"), F.round(F.max(F.col("scanned") / n), 6).alias("scan_frac"), own(0).alias("lane0"), own(1).alias("lane1"))


@query("lane_trace", SQL_FACTS + " SELECT source_session, coalesce(count(*) FILTER (WHERE kind = 'verbatim'), 0) AS verbatim, coalesce(count(*) FILTER (WHERE kind = 'atomic'), 0) AS atomic, max(time_bucket) FILTER (WHERE kind = 'atomic') AS last_atomic FROM facts GROUP BY source_session")
def lane_trace(spark, sf):
    """What each lane saw of a session."""
    own = lambda k: F.col("kind") == k
    return base.facts(spark, sf).groupBy("source_session").agg(F.count_if(own("verbatim")).alias("verbatim"), F.count_if(own("atomic")).alias("atomic"), F.max(F.when(own("atomic"), F.col("time_bucket"))).alias("last_atomic"))


@query("autoscale_budget", SQL_FACTS + " SELECT doc_id, count(*) AS facts, CASE WHEN count(*) < 500 THEN 1.0::DOUBLE ELSE 0.3 END AS budget FROM facts GROUP BY doc_id")
def autoscale_budget(spark, sf):
    return base.facts(spark, sf).groupBy("doc_id").agg(F.count("*").alias("facts")).select("doc_id", "facts", routing.budget(F.col("facts")).alias("budget"))


@query("is_changelog", f"WITH {scalars._ASKED} SELECT conv_id, turn, regexp_matches(text, {_q(routing.CHANGES)}) AS changelog FROM asked")
def is_changelog(spark, sf):
    return scalars._asked(spark, sf).select("conv_id", "turn", routing.is_changelog(F.col("text")).alias("changelog"))


@query("top_k_choice", f"""WITH {scalars._ASKED}, c AS (SELECT conv_id, turn, {scalars._CLASS} <> 'general' AS reasoning, regexp_matches(text, {_q(routing.ADVICE)}) AS advice FROM asked)
SELECT conv_id, turn, CASE WHEN reasoning AND NOT advice THEN 50 ELSE 20 END AS search, CASE WHEN reasoning THEN 50 ELSE 20 END AS answer FROM c""")
def top_k_choice(spark, sf):
    return scalars._asked(spark, sf).select("conv_id", "turn", routing.search_depth(F.col("text")).alias("k")).select("conv_id", "turn", "k.search", "k.answer")


@query("coerce_action", """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type WHEN event_id % 4 IN (1, 2) THEN 'search' ELSE 'reflect' END AS action FROM events""")
def coerce_action(spark, sf):
    """An action out of turn becomes a search, or a reflection."""
    k = F.col("event_id") % 4
    allowed = F.when(k == 0, F.array("event_type")).when(k == 3, F.array(F.lit("visit"))).otherwise(F.array(F.lit("search"), F.lit("visit")))
    return base.table(spark, sf, "events").select("event_id", routing.allowed_action(F.col("event_type"), allowed).alias("action"))


@query("activation_union", SQL_FACTS + """, act AS (SELECT 'entity' AS axis, fact_id FROM facts WHERE list_has_any(entities, ['mother', 'the', 'in']) UNION ALL SELECT 'time', fact_id FROM facts WHERE time_bucket <> 'unknown' UNION ALL SELECT 'topic', fact_id FROM facts WHERE doc_id IN ('doc:1', 'doc:2'))
SELECT fact_id, count(*) AS axes FROM act GROUP BY fact_id""")
def activation_union(spark, sf):
    """Facts of all activated buckets, with the number of axes that activate each."""
    f = base.facts(spark, sf)
    wanted = F.array(*map(F.lit, ("mother", "the", "in")))
    parts = [f.where(F.arrays_overlap("entities", wanted)), f.where("time_bucket <> 'unknown'"), f.where("doc_id in ('doc:1', 'doc:2')")]
    return parts[0].select("fact_id").union(parts[1].select("fact_id")).union(parts[2].select("fact_id")).groupBy("fact_id").agg(F.count("*").alias("axes"))


@query("kmeans_index", search._lloyd_sql(5, 2))
def kmeans_index(spark, sf):
    """The older index: as many topics as asked for, or as there are rows."""
    v = search._vectors(spark, sf).select("id", "vector")
    return vectors.lloyd(v, min(5, max(1, v.count())), 2)[0].select("id", F.col("bucket").cast("long").alias("bucket"), "similarity")


@query("route_index", SQL_FACTS + f""", asked AS (SELECT conv_id * 1000 + turn AS query_id, text FROM conversations WHERE role = 'user'),
known AS (SELECT DISTINCT unnest(entities) AS key FROM facts), months AS (SELECT DISTINCT time_bucket AS key FROM facts WHERE time_bucket <> 'unknown'),
ents AS (SELECT query_id, unnest({base.sql_entities('text')}) AS key FROM asked),
timed AS (SELECT query_id FROM asked WHERE {scalars._CLASS} = 'temporal')
SELECT query_id, 'entity' AS axis, count(*) AS buckets, min(key) AS first FROM ents JOIN known USING (key) GROUP BY query_id
UNION ALL SELECT query_id, 'time', (SELECT count(*) FROM months), (SELECT min(key) FROM months) FROM timed""")
def route_index(spark, sf):
    """The buckets that a question activates: entities it names that are known, all dated months if it is about time."""
    f = base.facts(spark, sf)
    asked = base.table(spark, sf, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), "text")
    known = f.select(F.explode("entities").alias("key")).distinct()
    named = asked.select("query_id", F.explode(text.entities(F.col("text"))).alias("key")).join(known, "key")
    by_name = named.groupBy("query_id").agg(F.count("*").alias("buckets"), F.min("key").alias("first")).select("query_id", F.lit("entity").alias("axis"), "buckets", "first")
    months = f.where("time_bucket <> 'unknown'").agg(F.countDistinct("time_bucket").alias("buckets"), F.min("time_bucket").alias("first"))  # one row
    by_time = asked.where(routing.question_class(F.col("text")) == "temporal").join(F.broadcast(months), F.lit(True)).select("query_id", F.lit("time").alias("axis"), "buckets", "first")
    return by_name.unionByName(by_time)


@query("topic_top2", search.SQL_ROUTED + " SELECT query_id, bucket, place FROM (SELECT query_id, bucket, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, bucket) AS place FROM routed) WHERE place <= 2")
def topic_top2(spark, sf):
    """The two nearest topics of each question (the index's topic axis)."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("similarity"), "bucket"))
    return search._routed(spark, sf).select("query_id", "bucket", place.cast("long").alias("place")).where("place <= 2")


@query("multiaxis_hop", SQL_FACTS + """, e AS (SELECT fact_id, doc_id, unnest(entities) AS key FROM facts), p AS (SELECT key FROM e GROUP BY key HAVING count(*) <= 50),
hit AS (SELECT DISTINCT key FROM e JOIN p USING (key) WHERE doc_id = 'doc:1') SELECT e.fact_id, count(*) AS matched FROM e JOIN hit USING (key) GROUP BY e.fact_id""")
def multiaxis_hop(spark, sf):
    """Second hop over bridging entities: facts that share rare entities (few postings) with the first hop's hits."""
    e = base.facts(spark, sf).select("fact_id", "doc_id", F.explode("entities").alias("key"))
    rare = e.groupBy("key").agg(F.count("*").alias("n"), F.max(F.col("doc_id") == "doc:1").alias("hit")).where("n <= 50 and hit").select("key")
    return e.join(rare, "key").groupBy("fact_id").agg(F.count("*").alias("matched"))


@query("lexical_gate", search.SQL_BM25 + " SELECT b.item_id AS query_id, count(l.id) AS lexical_hits, b.item_id % 2 = 1 AND count(l.id) > 0 AS has_cosine FROM benchmark b LEFT JOIN lex l ON l.query_id = b.item_id GROUP BY b.item_id")
def lexical_gate(spark, sf):
    """The lexical lane is off unless asked for (here by odd questions); with hits, cosines are computed too."""
    hits = search._lexical(spark, sf).groupBy("query_id").agg(F.count("*").alias("n"))
    asked = base.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"))
    n = F.coalesce("n", F.lit(0))
    return asked.join(hits, "query_id", "left").select("query_id", n.alias("lexical_hits"), ((F.col("query_id") % 2 == 1) & (n > 0)).alias("has_cosine"))


@query("rag_index", "SELECT doc_id, md5(source || chr(10) || text) AS passage, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '\\b(?:19|20)[0-9]{2}\\b'))), ',') AS years FROM documents")
def rag_index(spark, sf):
    """Passages as they are encoded, with the years they name."""
    years = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit(r"\b(?:19|20)[0-9]{2}\b"), F.lit(0))))
    return base.table(spark, sf, "documents").select("doc_id", F.md5(F.concat_ws("\n", "source", "text")).alias("passage"), F.array_join(years, ",").alias("years"))


@query("passage_text", "SELECT p_partkey, p_name || chr(10) || p_type AS passage FROM part")
def passage_text(spark, sf):
    return base.table(spark, sf, "part").select("p_partkey", F.concat_ws("\n", "p_name", "p_type").alias("passage"))


# -- dates, replies, gold rows


@query("is_unknown_ts", "SELECT o_orderkey, o_orderkey % 7 = 0 AS unknown FROM orders")
def is_unknown_ts(spark, sf):
    """The epoch stands for an unknown time."""
    ts = F.when(F.col("o_orderkey") % 7 == 0, F.lit("1970-01-01")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).cast("timestamp_ntz")
    return base.table(spark, sf, "orders").select("o_orderkey", (ts == F.lit("1970-01-01").cast("timestamp_ntz")).alias("unknown"))


@query("latest_anchor", "SELECT o_custkey, strftime(max(o_orderdate), '%Y-%m-%d') AS question_date, count(*) AS sessions FROM orders GROUP BY o_custkey")
def latest_anchor(spark, sf):
    """A question's date is that of the last session."""
    return base.table(spark, sf, "orders").groupBy("o_custkey").agg(F.date_format(F.max("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd").alias("question_date"), F.count("*").alias("sessions"))


@query("norm_date_map", "SELECT user_id, strftime(max(date_trunc('minute', ts)), '%Y-%m-%dT%H:%M:%S') AS last FROM events GROUP BY user_id")
def norm_date_map(spark, sf):
    """Spoken session dates read, the latest as the question's."""
    from recollect.functions import dates

    ts = F.col("ts").cast("timestamp_ntz")
    said = F.concat(F.lower(F.date_format(ts, "h:mm a")), F.lit(" on "), F.date_format(ts, "d MMMM, yyyy"))
    return base.table(spark, sf, "events").groupBy("user_id").agg(dates.iso_seconds(F.max(dates.spoken(said))).alias("last"))


@query("preprocess_gold", "SELECT conv_id, turn, CASE WHEN conv_id % 5 = 3 THEN role ELSE role || ' ; ' || text END AS gold FROM conversations")
def preprocess_gold(spark, sf):
    return base.table(spark, sf, "conversations").select("conv_id", "turn", parsing.gold_answer(F.col("conv_id") % 5, F.concat("role", F.lit(" ; "), "text")).alias("gold"))


_REPLIES = ['{"label": "Correct"}', 'Well. {"label": "wrong", "why": ""}', "I say it is correct.", "neither", '```json\n{"label": "CORRECT", "score": 1}\n```', '{"label": "maybe"}', "[1, 2]", "so: [3, 4, 5]."]
_LABELS = ["CORRECT", "WRONG", "CORRECT", "WRONG", "CORRECT", "MAYBE", "WRONG", "WRONG"]
_JSON = ['{"label": "Correct"}', '{"label": "wrong", "why": ""}', None, None, '{"label": "CORRECT", "score": 1}', '{"label": "maybe"}', "[1, 2]", "[3, 4, 5]"]


def _replies(spark, sf):
    reply = F.try_element_at(F.array(*map(F.lit, _REPLIES)), (F.col("event_id") % 8 + 1).cast("int"))
    return base.table(spark, sf, "events").select("event_id", reply.alias("reply"))


def _by_case(values) -> str:  # noqa: ANN001
    return "CASE event_id % 8 " + " ".join(f"WHEN {k} THEN {_q(v)}" for k, v in enumerate(values) if v is not None) + " END"


@query("extract_label", f"SELECT event_id, {_by_case(_LABELS)} AS label FROM events")
def extract_label(spark, sf):
    return _replies(spark, sf).select("event_id", parsing.label(F.col("reply")).alias("label"))


@query("parse_json_response", f"SELECT event_id, {_by_case(_JSON)} AS body FROM events")
def parse_json_response(spark, sf):
    return _replies(spark, sf).select("event_id", parsing.json_reply(F.col("reply")).alias("body"))


@query("extract_json_array", f"SELECT event_id, {_by_case([None] * 6 + _JSON[6:])} AS body FROM events")
def extract_json_array(spark, sf):
    return _replies(spark, sf).select("event_id", parsing.json_list(F.col("reply")).alias("body"))


@query("judge_parse", scalars.SQL_F1 + " SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN round(f1, 6) WHEN turn % 3 = 1 THEN 1.0 ELSE 0.7 END AS score, turn % 2 = 0 AS yes FROM f1")
def judge_parse(spark, sf):
    """A judge's number, held within 0 and 1, else the answers' F1; yes or no."""
    k = F.col("turn") % 3
    reply = F.when(k == 0, "no idea").when(k == 1, "Score: 9").otherwise("0.7, I think")
    score = F.round(parsing.judged_score(reply, F.col("gold"), F.col("said")), 6)
    return scalars._pairs(spark, sf).select("conv_id", "turn", score.alias("score"), parsing.says_yes(F.when(F.col("turn") % 2 == 0, "Yes.").otherwise("no")).alias("yes"))


@query("beam_questions", "SELECT p_partkey, p_type AS category, coalesce(CASE WHEN p_partkey % 3 = 0 THEN p_name END, CASE WHEN p_partkey % 3 < 2 THEN p_brand END, '') AS gold FROM part")
def beam_questions(spark, sf):
    """Questions by category, the first answer field that isn't empty as gold."""
    fields = [F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).otherwise(""), F.when(F.col("p_partkey") % 3 < 2, F.col("p_brand")), F.lit("")]
    return base.table(spark, sf, "part").select("p_partkey", F.col("p_type").alias("category"), F.coalesce(*[F.nullif(f, F.lit("")) for f in fields[:2]], fields[2]).alias("gold"))


@query("multihop_gold", """SELECT l_orderkey, array_to_string(list_sort(list_distinct(list('part ' || l_partkey) FILTER (WHERE l_returnflag <> 'N'))), '|') AS titles, CASE WHEN l_orderkey % 2 = 0 THEN '2hop' ELSE 'multihop' END AS hop_type FROM lineitem GROUP BY l_orderkey""")
def multihop_gold(spark, sf):
    """Distinct supporting titles in order, and the kind of question from its id."""
    qid = F.concat(F.when(F.col("l_orderkey") % 2 == 0, "2hop__").otherwise("q"), F.col("l_orderkey"))
    titles = F.array_sort(F.collect_set(F.when(F.col("l_returnflag") != "N", F.concat(F.lit("part "), "l_partkey"))))
    rows = base.table(spark, sf, "lineitem").groupBy("l_orderkey").agg(titles.alias("t"))
    hop = F.when(F.contains(qid, F.lit("hop")), F.concat(F.substring_index(qid, "hop", 1), F.lit("hop"))).otherwise("multihop")
    return rows.select("l_orderkey", F.when(F.size("t") > 0, F.array_join("t", "|")).alias("titles"), hop.alias("hop_type"))


@query("locomo_needles", "SELECT DISTINCT a.conv_id, b.turn FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 1 AND a.turn + 1 WHERE a.turn % 4 = 0 AND a.role = 'user'")
def locomo_needles(spark, sf):
    """Evidence turns with the turns beside them, within their session."""
    c = base.table(spark, sf, "conversations")
    around = c.where("turn % 4 = 0 and role = 'user'").select("conv_id", F.explode(F.sequence(F.col("turn") - 1, F.col("turn") + 1)).alias("turn")).distinct()
    return around.join(c.select("conv_id", "turn").distinct(), ["conv_id", "turn"])


# -- readers, reports


@query("fallback_answer", SQL_FACTS + """, n AS (SELECT source_session, pos, source_ref, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, row_number() OVER (PARTITION BY source_session ORDER BY pos) AS k FROM facts WHERE kind = 'verbatim')
SELECT source_session, string_agg('- ' || CASE WHEN length(t) > 140 THEN rtrim(substr(t, 1, 137)) || '...' ELSE t END || ' (' || source_ref || ')', chr(10) ORDER BY pos) AS answer FROM n WHERE k <= 6 GROUP BY source_session""")
def fallback_answer(spark, sf):
    """A session's first six notes with their references (a short report), where no answer could be made."""
    notes = base.facts(spark, sf).where("kind = 'verbatim'").select("source_session", "pos", "source_ref", text.squeeze(F.col("text")).alias("t"))
    line = F.concat(F.lit("- "), F.when(F.length("t") > 140, F.concat(F.rtrim(F.substring("t", 1, 137)), F.lit("..."))).otherwise(F.col("t")), F.lit(" ("), "source_ref", F.lit(")"))
    first = F.slice(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))), 1, 6)
    return notes.groupBy("source_session").agg(first.alias("l")).select("source_session", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("answer"))


@query("default_plan", "SELECT * FROM (VALUES (1, 'What is known'), (2, 'How it changed'), (3, 'What is open')) p(place, section)")
def default_plan(spark, sf):
    """Sections of a report without a plan of its own."""
    return spark.createDataFrame([(1, "What is known"), (2, "How it changed"), (3, "What is open")], "place int, section string")


_FRAME = "'As of ' || {0} || ': answer with what held on that day.' || chr(10)"


@query("reader_frame", SQL_FACTS + f" SELECT fact_id, CASE WHEN ts IS NULL THEN '' ELSE {_FRAME.format(chr(39) + chr(39) + ' || strftime(ts, ' + chr(39) + '%Y-%m-%d' + chr(39) + ')')} END || CASE WHEN source_speaker = 'user' THEN 'The memories are those of user.' || chr(10) ELSE '' END AS frame FROM facts")
def reader_frame(spark, sf):
    """What a reader is told first: the date to answer for, whose memories they are."""
    day = F.date_format("ts", "yyyy-MM-dd")
    dated = F.when(day.isNull(), "").otherwise(F.concat(F.lit("As of "), day, F.lit(": answer with what held on that day.\n")))
    owner = F.when(F.col("source_speaker") == "user", "The memories are those of user.\n").otherwise("")
    return base.facts(spark, sf).select("fact_id", F.concat(dated, owner).alias("frame"))


@query("reader_prompt", SQL_FACTS + """, l AS (SELECT source_session, pos, '[' || coalesce(strftime(ts, '%Y-%m-%d'), 'unknown-date') || '] ' || text AS line FROM facts WHERE kind = 'verbatim')
SELECT source_session, md5('Evidence:' || chr(10) || string_agg(line, chr(10) ORDER BY pos) || chr(10) || 'Question: what happened in ' || source_session || '?') AS prompt, count(*) AS lines FROM l GROUP BY source_session""")
def reader_prompt(spark, sf):
    """A dated reader's whole prompt: evidence in order, then the question."""
    line = F.concat(F.lit("["), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown-date")), F.lit("] "), "text")
    rows = base.facts(spark, sf).where("kind = 'verbatim'").groupBy("source_session").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    body = F.concat(F.lit("Evidence:\n"), F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\nQuestion: what happened in "), "source_session", F.lit("?"))
    return rows.select("source_session", F.md5(body).alias("prompt"), F.size("l").cast("long").alias("lines"))


@query("label_buckets", SQL_FACTS + """, e AS (SELECT doc_id, fact_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM facts WHERE kind = 'verbatim')
SELECT doc_id, string_agg(split_part(text, ' ', 1), ' ' ORDER BY k) AS label FROM e WHERE k <= 5 GROUP BY doc_id""")
def label_buckets(spark, sf):
    """A label for each bucket from its first five exemplars; the default labeller joins their first words."""
    v = base.facts(spark, sf).where("kind = 'verbatim'").select("doc_id", "pos", F.substring_index("text", " ", 1).alias("word"))
    # five a bucket and a document's share first, so that a large bucket is not gathered
    near = v.groupBy("doc_id", F.floor(F.col("pos") / 1000000).alias("part")).agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "word"))), 1, 5).alias("l"))
    best = near.groupBy("doc_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("l"))), 1, 5).alias("l"))
    return best.select("doc_id", F.array_join(F.transform("l", lambda x: x["word"]), " ").alias("label"))


@query("bench_estimate", scalars.SQL_USAGE + " SELECT c_custkey, used * 1000 AS tokens, round(used * 1000 / 1e6::DOUBLE * price, 6) AS usd FROM p")
def bench_estimate(spark, sf):
    """Tokens of a run, and their price where it is known."""
    tokens = F.col("used") * 1000
    return scalars._usage(spark, sf).select("c_custkey", tokens.alias("tokens"), F.round(tokens / 1e6 * text.price_per_million(F.col("m")), 6).alias("usd"))


@query("results_sink", "WITH c AS (SELECT lang AS category, CAST(quality AS DOUBLE) AS score FROM labels JOIN documents USING (doc_id)) SELECT category, count(*) AS n, round(avg(score), 6) AS mean FROM c GROUP BY category")
def results_sink(spark, sf):
    """A report's rows as they are written to JSON (sources.sinks) and read again."""
    from recollect.plans.shared import shared_root
    from recollect.sources import sinks

    rows = base.table(spark, sf, "labels").join(base.table(spark, sf, "documents"), "doc_id").groupBy(F.col("lang").alias("category")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("quality").cast("double")), 6).alias("mean"))
    return sinks.reread(rows, shared_root(spark) + "/results")
