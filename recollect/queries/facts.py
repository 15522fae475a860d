"""Queries over the fact table: lanes, identity, filters, mutations, provenance, counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import dates, text
from recollect.operators import mutations, overlaps, validity
from recollect.plans import base
from recollect.plans.base import SQL_FACTS, SQL_ORDERS, SQL_TURNS, sql_entities
from recollect.plans.shared import cut
from recollect.queries.registry import query


@query("content_id", SQL_FACTS + " SELECT fact_id, kind, pos FROM facts")
def content_id(spark, sf):
    return base.facts(spark, sf).select("fact_id", "kind", "pos")


_FACT_OUT = "fact_id, pos, text, strftime(ts, '%Y-%m-%d') AS day, array_to_string(entities, ',') AS entities, time_bucket, source_ref, source_speaker"


def _fact_out(df):
    return df.select("fact_id", "pos", "text", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.array_join("entities", ",").alias("entities"), "time_bucket", "source_ref", "source_speaker")


@query("ingest_verbatim", SQL_FACTS + f" SELECT {_FACT_OUT} FROM verbatim_rows")
def ingest_verbatim(spark, sf):
    return _fact_out(base.verbatim(base.turns(spark, sf)))


@query("ingest_atomic", SQL_FACTS + f" SELECT {_FACT_OUT} FROM atomic_rows")
def ingest_atomic(spark, sf):
    return _fact_out(base.atomic(base.turns(spark, sf)))


@query("ingest_single", SQL_FACTS + f" SELECT {_FACT_OUT} FROM verbatim_rows WHERE source_speaker NOT IN ('assistant', 'system')")
def ingest_single(spark, sf):
    return _fact_out(base.verbatim(base.turns(spark, sf).where(~F.col("role").isin("assistant", "system"))))


@query("build_transcript", "WITH " + SQL_TURNS + """
SELECT conv_id, string_agg('[T' || turn || '] ' || role || ': ' || CASE WHEN length(t) > 600 THEN substr(t, 1, 600) || '…' ELSE t END, chr(10) ORDER BY turn) AS transcript
FROM (SELECT *, replace(content, chr(10), ' ') AS t FROM turns) GROUP BY conv_id""")
def build_transcript(spark, sf):
    flat = F.replace("content", F.lit("\n"), F.lit(" "))
    line = F.concat(F.lit("[T"), F.col("turn"), F.lit("] "), "role", F.lit(": "), F.when(F.length(flat) > 600, F.concat(F.substring(flat, 1, 600), F.lit("…"))).otherwise(flat))
    rows = base.turns(spark, sf).select("conv_id", "turn", line.alias("line"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "line"))).alias("t")).select("conv_id", F.array_join(F.transform("t", lambda x: x["line"]), "\n").alias("transcript"))


@query("session_id", "WITH " + SQL_TURNS + """
SELECT conv_id, 'ingest:' || conv_id || ':' || substr(sha1(string_agg(role || ': ' || content, chr(10) ORDER BY turn) || '|' || coalesce(CAST(any_value(day) AS VARCHAR), '')), 1, 8) AS session_id
FROM turns GROUP BY conv_id""")
def session_id(spark, sf):
    rows = base.turns(spark, sf).groupBy("conv_id", "day").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "content").alias("line")))).alias("t"))
    body = F.concat(F.array_join(F.transform("t", lambda x: x["line"]), "\n"), F.lit("|"), F.coalesce(F.col("day").cast("string"), F.lit("")))
    return rows.select("conv_id", F.concat(F.lit("ingest:"), F.col("conv_id"), F.lit(":"), text.short_hash(body, 8)).alias("session_id"))


@query("source_ref", SQL_FACTS + " SELECT fact_id, source_ref, CASE WHEN CAST(split_part(source_ref, '/turn:', 2) AS INTEGER) < 4 THEN source_ref ELSE source_session END AS ref FROM facts")
def source_ref(spark, sf):
    turn = F.substring_index("source_ref", "/turn:", -1).cast("int")
    return base.facts(spark, sf).select("fact_id", "source_ref", F.when(turn < 4, F.col("source_ref")).otherwise(F.col("source_session")).alias("ref"))


@query("distill_mode", "SELECT conv_id, CASE WHEN bool_and(role <> 'assistant') THEN 'document' ELSE 'chat' END AS mode FROM conversations GROUP BY conv_id")
def distill_mode(spark, sf):
    return base.turns(spark, sf).groupBy("conv_id").agg(F.when(F.bool_and(F.col("role") != "assistant"), "document").otherwise("chat").alias("mode"))


@query("present_line", SQL_FACTS + " SELECT fact_id, '[' || coalesce(strftime(ts, '%Y-%m-%d'), 'unknown-date') || '] ' || text AS line FROM facts")
def present_line(spark, sf):
    return base.facts(spark, sf).select("fact_id", F.concat(F.lit("["), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("unknown-date")), F.lit("] "), "text").alias("line"))


@query("hit_ref", SQL_FACTS + " SELECT fact_id, 'mem:' || substr(fact_id, 1, 12) AS ref FROM facts")
def hit_ref(spark, sf):
    return base.facts(spark, sf).select("fact_id", F.concat(F.lit("mem:"), F.substring("fact_id", 1, 12)).alias("ref"))


@query("facts_page", SQL_FACTS + " SELECT fact_id, pos, count(*) OVER () AS total FROM facts WHERE kind = 'atomic' ORDER BY pos LIMIT 50 OFFSET 100")
def facts_page(spark, sf):
    lane = base.facts(spark, sf).where("kind = 'atomic'")
    total = lane.agg(F.count("*").alias("total"))
    return lane.select("fact_id", "pos").orderBy("pos").offset(100).limit(50).join(F.broadcast(total), F.lit(True))


@query("lane_view", SQL_FACTS + " SELECT fact_id, text, source_session, doc_id FROM facts WHERE kind = 'verbatim'")
def lane_view(spark, sf):
    return base.facts(spark, sf).where("kind = 'verbatim'").select("fact_id", "text", "source_session", "doc_id")


@query("list_atomic", SQL_FACTS + " SELECT fact_id, text, strftime(ts, '%Y-%m-%d') AS day, array_to_string(entities, ',') AS entities FROM facts WHERE kind = 'atomic'")
def list_atomic(spark, sf):
    return base.facts(spark, sf).where("kind = 'atomic'").select("fact_id", "text", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.array_join("entities", ",").alias("entities"))


@query("parse_facts", """WITH lines AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM conversations),
raw AS (SELECT conv_id, turn, n, trim(regexp_replace((turn || ' | - ' || line), '^\\s*[-*•]\\s*', '')) AS line FROM lines),
cut AS (SELECT *, CAST(regexp_extract(line, '^(\\d+)\\s*\\|\\s*(.*)$', 1) AS INTEGER) AS idx, trim(regexp_replace(regexp_extract(line, '^(\\d+)\\s*\\|\\s*(.*)$', 2), '^\\s*[-*•]\\s*', '')) AS fact FROM raw)
SELECT conv_id, turn, n, idx, fact FROM cut WHERE length(fact) >= 4 AND upper(fact) <> 'NONE'""")
def parse_facts(spark, sf):
    """Distilled lines ``index | fact``, bullets stripped, short ones and NONE dropped."""
    bullet = r"^\s*[-*•]\s*"
    lines = base.table(spark, sf, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("k", "line"))
    raw = lines.withColumn("line", F.trim(F.regexp_replace(F.concat(F.col("turn"), F.lit(" | - "), "line"), bullet, "")))
    pattern = r"^(\d+)\s*\|\s*(.*)$"
    cut = raw.select("conv_id", "turn", (F.col("k") + 1).cast("long").alias("n"), F.regexp_extract("line", pattern, 1).cast("int").alias("idx"), F.trim(F.regexp_replace(F.regexp_extract("line", pattern, 2), bullet, "")).alias("fact"))
    return cut.where((F.length("fact") >= 4) & (F.upper("fact") != "NONE"))


# -- validity


_ACTIVE = "coalesce(ts <= {0}, true) AND coalesce(valid_to > {0}, true) AND NOT (superseded_by <> '' AND valid_to IS NULL)".format("TIMESTAMP '1997-06-01'")


@query("active_as_of", SQL_ORDERS + f" SELECT fact_id, {_ACTIVE} AS active, superseded_by = '' AS active_now, coalesce(ts <= TIMESTAMP '1997-06-01', true) AS with_history FROM order_facts")
def active_as_of(spark, sf):
    c = [F.col("ts"), F.col("superseded_by"), F.col("valid_to")]
    d = F.lit("1997-06-01").cast("timestamp_ntz")
    return base.order_facts(spark, sf).select("fact_id", validity.active(d, *c).alias("active"), validity.active(F.lit(None).cast("timestamp_ntz"), *c).alias("active_now"), validity.active(d, *c, history=True).alias("with_history"))


@query("fact_status", SQL_ORDERS + " SELECT fact_id, CASE WHEN ts > TIMESTAMP '1997-06-01' THEN 'historical' WHEN superseded_by <> '' AND coalesce(valid_to <= TIMESTAMP '1997-06-01', true) THEN 'superseded' ELSE 'current' END AS status FROM order_facts")
def fact_status(spark, sf):
    return base.order_facts(spark, sf).select("fact_id", validity.status(F.lit("1997-06-01").cast("timestamp_ntz"), F.col("ts"), F.col("superseded_by"), F.col("valid_to")).alias("status"))


@query("j_asof", SQL_ORDERS + """ SELECT e.event_id, f.fact_id, f.value FROM (SELECT event_id, user_id, TIMESTAMP '1995-01-01' + to_days(CAST(event_id % 1800 AS INTEGER)) AS asked FROM events) e
LEFT JOIN order_facts f ON e.user_id = f.subject AND f.ts <= e.asked AND (f.valid_to IS NULL OR f.valid_to > e.asked)""")
def j_asof(spark, sf):
    asked = (F.lit("1995-01-01").cast("timestamp_ntz") + F.make_dt_interval((F.col("event_id") % 1800).cast("int")))
    questions = base.table(spark, sf, "events").select("event_id", F.col("user_id").alias("subject"), asked.alias("asked"))
    return validity.as_of_join(questions, base.order_facts(spark, sf), "subject").select("q.event_id", "f.fact_id", "f.value")


@query("supersede", SQL_ORDERS + """, pairs AS (SELECT fact_id AS old_id, superseded_by AS new_id, valid_to FROM order_facts WHERE superseded_by <> '' AND value = 'F'),
plain AS (SELECT fact_id, '' AS superseded_by, NULL AS valid_to FROM order_facts)
SELECT p.fact_id, coalesce(x.new_id, p.superseded_by) AS superseded_by, strftime(x.valid_to, '%Y-%m-%d') AS valid_to FROM plain p LEFT JOIN pairs x ON p.fact_id = x.old_id""")
def supersede(spark, sf):
    facts = base.order_facts(spark, sf)
    pairs = facts.where("superseded_by <> '' and value = 'F'").select(F.col("fact_id").alias("old_id"), F.col("superseded_by").alias("new_id"), "valid_to")
    plain = facts.select("fact_id", F.lit("").alias("superseded_by"), F.lit(None).cast("timestamp_ntz").alias("valid_to"))
    return mutations.superseded(plain, pairs).withColumn("valid_to", F.date_format("valid_to", "yyyy-MM-dd"))


@query("delete_facts", SQL_ORDERS + """, gone AS (SELECT fact_id FROM order_facts WHERE value = 'P')
SELECT f.fact_id, CASE WHEN g.fact_id IS NOT NULL THEN '' ELSE f.superseded_by END AS superseded_by, CASE WHEN g.fact_id IS NULL THEN strftime(f.valid_to, '%Y-%m-%d') END AS valid_to
FROM order_facts f LEFT JOIN gone g ON f.superseded_by = CAST(g.fact_id AS VARCHAR) WHERE f.fact_id NOT IN (SELECT fact_id FROM gone)""")
def delete_facts(spark, sf):
    facts = base.order_facts(spark, sf)
    out = mutations.deleted(facts, facts.where("value = 'P'"))
    return out.select("fact_id", "superseded_by", F.date_format("valid_to", "yyyy-MM-dd").alias("valid_to"))


@query("kinds_hist", SQL_FACTS + " SELECT kind, count(*) AS n FROM facts WHERE doc_id = 'doc:3' GROUP BY kind")
def kinds_hist(spark, sf):
    return base.facts(spark, sf).where("doc_id = 'doc:3'").groupBy("kind").agg(F.count("*").alias("n"))


@query("upsert_dedup", SQL_FACTS + """, bank AS (SELECT fact_id FROM facts WHERE doc_id < 'doc:5'), batch AS (SELECT * FROM verbatim_rows UNION ALL SELECT * FROM atomic_rows)
SELECT fact_id, min(pos) AS pos FROM batch WHERE fact_id NOT IN (SELECT fact_id FROM bank) GROUP BY fact_id""")
def upsert_dedup(spark, sf):
    rows = base.turns(spark, sf)
    bank = base.facts(spark, sf).where("doc_id < 'doc:5'")
    return mutations.upserted(bank, base.verbatim(rows).unionByName(base.atomic(rows))).select("fact_id", "pos")


@query("existing_ids", SQL_FACTS + ", bank AS (SELECT fact_id FROM facts WHERE doc_id < 'doc:5') SELECT DISTINCT fact_id FROM verbatim_rows WHERE fact_id IN (SELECT fact_id FROM bank)")
def existing_ids(spark, sf):
    return mutations.existing_ids(base.facts(spark, sf).where("doc_id < 'doc:5'"), base.verbatim(base.turns(spark, sf)))


_DOOMED = ", ids AS (SELECT fact_id FROM facts WHERE kind = 'atomic' AND time_bucket = '2024-02')"


@query("orphaned_source", SQL_FACTS + _DOOMED + """, doomed AS (SELECT DISTINCT doc_id, source_session, source_ref FROM facts WHERE kind = 'atomic' AND fact_id IN (SELECT fact_id FROM ids)),
alive AS (SELECT DISTINCT doc_id, source_session, source_ref FROM facts WHERE kind = 'atomic' AND fact_id NOT IN (SELECT fact_id FROM ids))
SELECT fact_id FROM facts f WHERE kind = 'verbatim' AND (doc_id, source_session, source_ref) IN (SELECT (doc_id, source_session, source_ref) FROM doomed)
AND (doc_id, source_session, source_ref) NOT IN (SELECT (doc_id, source_session, source_ref) FROM alive)""")
def orphaned_source(spark, sf):
    facts = base.facts(spark, sf)
    return mutations.orphaned_sources(facts, facts.where("kind = 'atomic' and time_bucket = '2024-02'")).select("fact_id")


@query("source_group", SQL_FACTS + _DOOMED + """, keys AS (SELECT DISTINCT doc_id, source_session, source_ref FROM facts WHERE fact_id IN (SELECT fact_id FROM ids))
SELECT DISTINCT f.fact_id FROM facts f JOIN keys k ON f.doc_id = k.doc_id AND f.source_session = k.source_session AND (f.source_ref = k.source_ref OR starts_with(f.source_ref, k.source_ref || '/turn:'))""")
def source_group(spark, sf):
    facts = base.facts(spark, sf)
    return mutations.source_group(facts, facts.where("kind = 'atomic' and time_bucket = '2024-02'")).select("fact_id")


@query("resolve_ids", SQL_FACTS + """, refs AS (SELECT 'mem:' || substr(fact_id, 1, 12) AS ref FROM facts UNION SELECT fact_id FROM facts WHERE kind = 'atomic' UNION SELECT 'unknown')
SELECT r.ref, count(f.fact_id) AS n, CASE WHEN count(f.fact_id) = 1 THEN min(f.fact_id) END AS fact_id FROM refs r LEFT JOIN facts f ON r.ref = f.fact_id OR r.ref = 'mem:' || substr(f.fact_id, 1, 12) GROUP BY r.ref""")
def resolve_ids(spark, sf):
    facts = base.facts(spark, sf)
    refs = facts.select(F.concat(F.lit("mem:"), F.substring("fact_id", 1, 12)).alias("ref")).union(facts.where("kind = 'atomic'").select("fact_id")).union(spark.range(1).select(F.lit("unknown"))).distinct()
    return mutations.resolved(facts, refs)


# -- filters


@query("build_filter", SQL_FACTS + """ SELECT fact_id FROM facts WHERE kind = 'verbatim' AND (doc_id IN ('doc:1', 'doc:4') OR list_has_any(entities, ['mother', 'the', 'inst'])
OR (ts >= TIMESTAMP '2024-02-01' AND ts < TIMESTAMP '2024-03-01') OR ts IS NULL)""")
def build_filter(spark, sf):
    axis = F.col("doc_id").isin("doc:1", "doc:4") | F.arrays_overlap("entities", F.array(*map(F.lit, ("mother", "the", "inst"))))
    axis = axis | ((F.col("ts") >= "2024-02-01") & (F.col("ts") < "2024-03-01")) | F.col("ts").isNull()
    return base.facts(spark, sf).where((F.col("kind") == "verbatim") & axis).select("fact_id")


@query("filter_grammar", "SELECT c_custkey FROM customer WHERE (c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal >= 9000) AND c_name SIMILAR TO 'Customer#.*[0-9]7' AND c_acctbal < 9900")
def filter_grammar(spark, sf):
    c = base.table(spark, sf, "customer")
    return c.where((F.col("c_mktsegment").isin("BUILDING", "MACHINERY") | (F.col("c_acctbal") >= 9000)) & text.glob(F.col("c_name"), "Customer#*7") & F.col("c_name").rlike("[0-9]7$") & (F.col("c_acctbal") < 9900)).select("c_custkey")


_QUESTION = "(event_type || ' in ' || strftime(ts, CASE event_id % 4 WHEN 0 THEN '%Y-%m-%d' WHEN 1 THEN '%B %Y' WHEN 2 THEN '%Y' ELSE '%B' END) || '?')"


def _questions(spark, sf):
    day = F.col("ts").cast("timestamp_ntz")
    form = F.when(F.col("event_id") % 4 == 0, F.date_format(day, "yyyy-MM-dd")).when(F.col("event_id") % 4 == 1, F.date_format(day, "MMMM yyyy")).when(F.col("event_id") % 4 == 2, F.date_format(day, "yyyy")).otherwise(F.date_format(day, "MMMM"))
    return base.table(spark, sf, "events").select("event_id", "ts", "event_type", F.concat("event_type", F.lit(" in "), form, F.lit("?")).alias("question"))


@query("query_time_range", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('month', ts), '%Y-%m-%d') WHEN 2 THEN strftime(date_trunc('year', ts), '%Y-%m-%d') END AS start_day,
CASE event_id % 4 WHEN 0 THEN strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') WHEN 1 THEN strftime(date_trunc('month', ts) + INTERVAL 1 MONTH, '%Y-%m-%d') WHEN 2 THEN strftime(date_trunc('year', ts) + INTERVAL 1 YEAR, '%Y-%m-%d') END AS end_day FROM events""")
def query_time_range(spark, sf):
    r = dates.question_range(F.col("question"))
    return _questions(spark, sf).select("event_id", r["start"].cast("string").alias("start_day"), r["end"].cast("string").alias("end_day"))


@query("query_time_keys", """WITH keys AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS key FROM orders)
SELECT DISTINCT e.event_id, k.key FROM events e JOIN keys k ON (e.event_id % 4 IN (0, 2) AND starts_with(k.key, strftime(e.ts, '%Y')))
OR (e.event_id % 4 = 1 AND k.key = strftime(e.ts, '%Y-%m')) OR (e.event_id % 4 = 3 AND ends_with(k.key, strftime(e.ts, '-%m')))""")
def query_time_keys(spark, sf):
    """The month buckets that a question may mean: year and month, a year's, or a month's of any year."""
    keys = base.table(spark, sf, "orders").select(dates.month_bucket(F.col("o_orderdate")).alias("key")).distinct()
    keys = keys.withColumns({"y": F.substring("key", 1, 4).cast("int"), "m": F.substring("key", 6, 2).cast("int")})
    asked = _questions(spark, sf).select("event_id", dates.years_in(F.col("question")).alias("ys"), dates.months_in(F.col("question")).alias("ms"))
    asked = asked.where((F.size("ys") > 0) | (F.size("ms") > 0)).select("event_id", F.explode_outer("ys").alias("ay"), "ms").select("event_id", "ay", F.explode_outer("ms").alias("am"))
    hit = (F.col("ay").isNull() | (F.col("ay") == F.col("y"))) & (F.col("am").isNull() | (F.col("am") == F.col("m")))
    return asked.join(F.broadcast(keys), hit).select("event_id", "key").distinct()


@query("query_entities", f"SELECT conv_id, turn, array_to_string({sql_entities('text')}, ',') AS entities FROM conversations")
def query_entities(spark, sf):
    return base.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.entities(F.col("text")), ",").alias("entities"))


@query("live_only", SQL_ORDERS + " SELECT fact_id FROM order_facts WHERE superseded_by = ''")
def live_only(spark, sf):
    return base.order_facts(spark, sf).where("superseded_by = ''").select("fact_id")


# -- provenance and joins on entities and time


@query("j_entity", SQL_FACTS + """, q AS (SELECT conv_id, turn, unnest(""" + sql_entities("text") + """) AS e FROM conversations WHERE role = 'user')
SELECT q.conv_id, q.turn, count(DISTINCT f.fact_id) AS facts, count(DISTINCT f.source_session) AS sessions FROM q JOIN (SELECT *, unnest(entities) AS e FROM facts WHERE kind = 'atomic') f ON q.e = f.e GROUP BY q.conv_id, q.turn""")
def j_entity(spark, sf):
    found = base.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.explode(text.entities(F.col("text"))).alias("e"))
    asked = cut(found.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_set("e")).alias("es")))
    facts = base.facts(spark, sf).where("kind = 'atomic' and size(entities) > 0").select(F.col("source_session").alias("grp"), F.col("entities").alias("es"))
    counts = overlaps.reached(asked, cut(facts))
    return asked.join(counts, "es").select("conv_id", "turn", F.col("items").alias("facts"), F.col("groups").alias("sessions"))


@query("j_time", SQL_FACTS + " SELECT time_bucket, count(*) AS n, count(DISTINCT source_session) AS sessions FROM facts WHERE time_bucket IN (SELECT strftime(DATE '2024-01-01' + CAST(conv_id AS INTEGER), '%Y-%m') FROM conversations) GROUP BY time_bucket")
def j_time(spark, sf):
    wanted = base.table(spark, sf, "conversations").select(dates.month_bucket(F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int"))).alias("time_bucket")).distinct()
    return base.facts(spark, sf).join(wanted, "time_bucket", "left_semi").groupBy("time_bucket").agg(F.count("*").alias("n"), F.countDistinct("source_session").alias("sessions"))


@query("j_provenance", SQL_FACTS + """ SELECT f.fact_id, c.turn, c.role, md5(c.text) AS body FROM (SELECT *, CAST(substr(source_session, 9) AS BIGINT) AS conv, CAST(split_part(source_ref, '/turn:', 2) AS BIGINT) AS t FROM facts WHERE kind = 'atomic') f
JOIN conversations c ON c.conv_id = f.conv AND c.turn BETWEEN f.t - 1 AND f.t + 1""")
def j_provenance(spark, sf):
    """Each atomic fact with its source turn and one turn around it: three equalities instead of a range."""
    at = F.substring_index("source_ref", "/turn:", -1).cast("long")
    facts = base.facts(spark, sf).where("kind = 'atomic'").select("fact_id", F.substring("source_session", 9, 20).cast("long").alias("conv_id"), F.explode(F.array(at - 1, at, at + 1)).alias("turn"))
    return facts.join(base.table(spark, sf, "conversations"), ["conv_id", "turn"]).select("fact_id", "turn", "role", F.md5("text").alias("body"))


@query("j_evidence_window", """WITH needles AS (SELECT conv_id, turn FROM conversations WHERE length(text) > 1500)
SELECT DISTINCT c.conv_id, c.turn FROM conversations c JOIN needles n ON c.conv_id = n.conv_id AND c.turn BETWEEN n.turn - 2 AND n.turn + 2""")
def j_evidence_window(spark, sf):
    c = base.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    needles = c.where(F.length("text") > 1500).select("conv_id", F.explode(F.sequence(F.col("turn") - 2, F.col("turn") + 2)).alias("turn")).distinct()
    return c.select("conv_id", "turn").join(needles, ["conv_id", "turn"], "left_semi").distinct()


# -- counts


@query("count_kind", SQL_FACTS + " SELECT count(*) AS n, count(*) FILTER (WHERE kind = 'atomic') AS atomic, count(*) FILTER (WHERE kind = 'verbatim') AS verbatim, max(CAST(ts AS DATE))::VARCHAR AS latest FROM facts")
def count_kind(spark, sf):
    return base.facts(spark, sf).agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "atomic").alias("atomic"), F.count_if(F.col("kind") == "verbatim").alias("verbatim"), F.max(F.to_date("ts")).cast("string").alias("latest"))


@query("ingest_report", SQL_FACTS + """, batch AS (SELECT * FROM verbatim_rows UNION ALL SELECT * FROM atomic_rows)
SELECT source_session, count(DISTINCT fact_id) AS n_stored, count(*) FILTER (WHERE kind = 'atomic') AS n_extracted, count(*) FILTER (WHERE kind = 'verbatim') AS n_verbatim,
CASE WHEN count(*) FILTER (WHERE kind = 'atomic') = 0 THEN 'verbatim_only' ELSE 'ok' END AS status FROM batch GROUP BY source_session""")
def ingest_report(spark, sf):
    rows = base.turns(spark, sf)
    batch = base.verbatim(rows).unionByName(base.atomic(rows))
    n = F.count_if(F.col("kind") == "atomic")
    return batch.groupBy("source_session").agg(F.countDistinct("fact_id").alias("n_stored"), n.alias("n_extracted"), F.count_if(F.col("kind") == "verbatim").alias("n_verbatim"), F.when(n == 0, "verbatim_only").otherwise("ok").alias("status"))


@query("dataset_summary", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def dataset_summary(spark, sf):
    return base.table(spark, sf, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.countDistinct("conv_id").alias("conversations"))


@query("bucket_summary", SQL_FACTS + """, e AS (SELECT 'entity' AS axis, unnest(entities) AS key FROM facts), a AS (SELECT * FROM e UNION ALL SELECT 'time', time_bucket FROM facts UNION ALL SELECT 'topic', doc_id FROM facts),
n AS (SELECT axis, key, count(*) AS size FROM a GROUP BY axis, key)
SELECT axis, key, size FROM (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY size DESC, key) AS k FROM n) WHERE axis <> 'entity' OR k <= 20""")
def bucket_summary(spark, sf):
    """Sizes on all axes; of entities the 20 largest."""
    f = base.facts(spark, sf)
    axis = lambda name, key: f.select(F.lit(name).alias("axis"), key.alias("key"))
    sizes = axis("entity", F.explode("entities")).union(axis("time", F.col("time_bucket"))).union(axis("topic", F.col("doc_id"))).groupBy("axis", "key").agg(F.count("*").alias("size"))
    k = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("size"), "key"))
    return sizes.withColumn("k", k).where("axis <> 'entity' or k <= 20").drop("k")


# -- order


@query("sort_temporal", SQL_FACTS + " SELECT source_session, fact_id, row_number() OVER (PARTITION BY doc_id, kind ORDER BY ts NULLS FIRST, pos) AS place FROM facts")
def sort_temporal(spark, sf):
    w = Window.partitionBy("doc_id", "kind").orderBy(F.col("ts").asc_nulls_first(), "pos")
    return base.facts(spark, sf).select("source_session", "fact_id", F.row_number().over(w).cast("long").alias("place"))


@query("concat_lanes", SQL_FACTS + " SELECT doc_id, fact_id, row_number() OVER (PARTITION BY doc_id ORDER BY CASE kind WHEN 'verbatim' THEN 0 ELSE 1 END, ts NULLS FIRST, pos) AS place FROM facts")
def concat_lanes(spark, sf):
    w = Window.partitionBy("doc_id").orderBy(F.when(F.col("kind") == "verbatim", 0).otherwise(1), F.col("ts").asc_nulls_first(), "pos")
    return base.facts(spark, sf).select("doc_id", "fact_id", F.row_number().over(w).cast("long").alias("place"))


@query("global_sort", SQL_FACTS + " SELECT doc_id, fact_id, row_number() OVER (PARTITION BY doc_id ORDER BY ts NULLS FIRST, CASE kind WHEN 'verbatim' THEN 0 ELSE 1 END, pos) AS place FROM facts")
def global_sort(spark, sf):
    w = Window.partitionBy("doc_id").orderBy(F.col("ts").asc_nulls_first(), F.when(F.col("kind") == "verbatim", 0).otherwise(1), "pos")
    return base.facts(spark, sf).select("doc_id", "fact_id", F.row_number().over(w).cast("long").alias("place"))


@query("sample_recent", SQL_FACTS + " SELECT fact_id, strftime(ts, '%Y-%m-%d') AS day FROM facts WHERE kind = 'atomic' ORDER BY ts DESC NULLS LAST, pos LIMIT 40")
def sample_recent(spark, sf):
    """The 40 latest atomic facts (a top-k report)."""
    return base.facts(spark, sf).where("kind = 'atomic'").orderBy(F.col("ts").desc_nulls_last(), "pos").limit(40).select("fact_id", F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query("topic_exemplars", SQL_FACTS + " SELECT doc_id, k AS place, substr(text, 1, 150) AS head FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM facts WHERE kind = 'atomic') WHERE k <= 3")
def topic_exemplars(spark, sf):
    w = Window.partitionBy("doc_id").orderBy("pos")
    return base.facts(spark, sf).where("kind = 'atomic'").withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("doc_id", "place", F.substring("text", 1, 150).alias("head"))


@query("evidence_dedupe", SQL_FACTS + " SELECT source_ref, min(pos) AS pos FROM facts GROUP BY source_ref")
def evidence_dedupe(spark, sf):
    return base.facts(spark, sf).groupBy("source_ref").agg(F.min("pos").alias("pos"))


@query("citation_split", SQL_FACTS + """, cited AS (SELECT DISTINCT conv_id, turn, 'session:' || conv_id || '/turn:' || (turn + 1) AS ref FROM conversations), known AS (SELECT DISTINCT source_ref FROM facts)
SELECT conv_id, count(*) FILTER (WHERE source_ref IS NOT NULL) AS valid, string_agg(ref, ',' ORDER BY turn) FILTER (WHERE source_ref IS NULL) AS invalid FROM cited LEFT JOIN known ON ref = source_ref GROUP BY conv_id""")
def citation_split(spark, sf):
    cited = base.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("session:"), F.col("conv_id"), F.lit("/turn:"), F.col("turn") + 1).alias("ref")).distinct()
    known = base.facts(spark, sf).select(F.col("source_ref").alias("ref"), F.lit(True).alias("known")).distinct()
    out = cited.join(known, "ref", "left").groupBy("conv_id").agg(F.count_if(F.col("known")).alias("valid"), F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.struct("turn", "ref")))).alias("bad"))
    return out.select("conv_id", "valid", F.when(F.size("bad") > 0, F.array_join(F.transform("bad", lambda x: x["ref"]), ",")).alias("invalid"))
