"""Queries of row-level functions, question routing, evaluation and record sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from recollect.functions import dates, routing, text
from recollect.operators import evaluation
from recollect.plans import base
from recollect.queries.registry import query


def sql_list(values) -> str:  # noqa: ANN001
    return base.sql_list(values)


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


NORMAL = "array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[!-/:-@\\[-`{{-~]', '', 'g'), '\\s+'), lambda w: w <> '' AND NOT list_contains(['a', 'an', 'the'], w)), ' ')"
PAIRS = """pairs AS (SELECT a.conv_id, a.turn, a.text AS gold, b.text AS said FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _pairs(spark, sf):
    c = base.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return c.withColumnRenamed("text", "gold").join(c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("said")), ["conv_id", "turn"])


@query("normalize_answer", f"SELECT doc_id, md5({NORMAL.format('text')}) AS body FROM documents")
def normalize_answer(spark, sf):
    return base.table(spark, sf, "documents").select("doc_id", F.md5(text.normalized_answer(F.col("text"))).alias("body"))


SQL_F1 = f"""WITH {PAIRS}, n AS (SELECT conv_id, turn, list_filter(string_split({NORMAL.format('gold')}, ' '), lambda w: w <> '') AS g, list_filter(string_split({NORMAL.format('said')}, ' '), lambda w: w <> '') AS p FROM pairs),
gt AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(g) AS w FROM n) GROUP BY ALL), pt AS (SELECT conv_id, turn, w, count(*) AS c FROM (SELECT conv_id, turn, unnest(p) AS w FROM n) GROUP BY ALL),
o AS (SELECT conv_id, turn, sum(least(gt.c, pt.c)) AS shared FROM gt JOIN pt USING (conv_id, turn, w) GROUP BY conv_id, turn),
f1 AS (SELECT n.conv_id, n.turn, CASE WHEN coalesce(shared, 0) = 0 THEN 0.0::DOUBLE ELSE 2 * (shared / len(p)) * (shared / len(g)) / (shared / len(p) + shared / len(g)) END AS f1, CASE WHEN array_to_string(g, ' ') = array_to_string(p, ' ') THEN 1.0::DOUBLE ELSE 0.0 END AS em FROM n LEFT JOIN o USING (conv_id, turn))"""


@query("f1_single", SQL_F1 + " SELECT conv_id, turn, round(f1, 6) AS f1, em FROM f1")
def f1_single(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", F.round(text.token_f1(F.col("gold"), F.col("said")), 6).alias("f1"), text.exact_match(F.col("gold"), F.col("said")).alias("em"))


@query("em_f1_corpus", SQL_F1 + ", best AS (SELECT conv_id, max(f1) AS f1, max(em) AS em FROM f1 GROUP BY conv_id) SELECT round(100 * avg(f1), 6) AS f1, round(100 * avg(em), 6) AS em, count(*) AS questions FROM best")
def em_f1_corpus(spark, sf):
    best = _pairs(spark, sf).groupBy("conv_id").agg(F.max(text.token_f1(F.col("gold"), F.col("said"))).alias("f1"), F.max(text.exact_match(F.col("gold"), F.col("said"))).alias("em"))
    return best.agg(F.round(100 * F.avg("f1"), 6).alias("f1"), F.round(100 * F.avg("em"), 6).alias("em"), F.count("*").alias("questions"))


_SET = "list_distinct(list_filter(string_split(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query("legacy_f1", f"WITH {PAIRS}, s AS (SELECT conv_id, turn, {_SET.format('gold')} AS g, {_SET.format('said')} AS p FROM pairs), b AS (SELECT *, len(list_intersect(g, p)) AS shared FROM s) SELECT conv_id, turn, round(CASE WHEN shared = 0 THEN 0.0::DOUBLE ELSE 2 * (shared / len(p)) * (shared / len(g)) / (shared / len(p) + shared / len(g)) END, 6) AS f1 FROM b")
def legacy_f1(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", F.round(text.set_f1(F.col("gold"), F.col("said")), 6).alias("f1"))


_NQ = "regexp_replace(trim(regexp_replace(lower({0}), '\\s+', ' ', 'g')), '[^\\p{{L}}\\p{{N}}_\\s@.+:-]', '', 'g')"


@query("query_jaccard", f"WITH {PAIRS}, s AS (SELECT conv_id, turn, list_distinct(list_filter(string_split({_NQ.format('gold')}, ' '), lambda w: w <> '')) AS g, list_distinct(list_filter(string_split({_NQ.format('said')}, ' '), lambda w: w <> '')) AS p FROM pairs) SELECT conv_id, turn, round(len(list_intersect(g, p)) / len(list_distinct(list_concat(g, p))), 6) AS jaccard FROM s")
def query_jaccard(spark, sf):
    return _pairs(spark, sf).select("conv_id", "turn", F.round(text.query_jaccard(F.col("gold"), F.col("said")), 6).alias("jaccard"))


@query("query_dedupe")
def query_dedupe(spark, sf):
    """Greedy near-duplicate removal over a customer segment's order comments; order matters, so SQL has no short form."""
    o = base.table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.concat_ws(" ", F.lit("orders with"), "o_orderpriority", F.lit("status"), "o_orderstatus").alias("q"))
    lists = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "q"))).alias("l"))
    return lists.select("o_custkey", F.array_join(text.deduped_queries(F.transform("l", lambda x: x["q"])), "|").alias("queries"))


MODELS = ["gpt-4o-mini", "GPT-4o", "gpt-4.1", "o4-mini", "claude-haiku-x", "claude-opus", "gemini-2.5-flash", "local:qwen", "ollama:phi", "gemma-4", "other"]
_MODEL = f"{sql_list(MODELS)}[c_custkey % {len(MODELS)} + 1]"
_PRICE = "CASE WHEN contains(lower(m), 'ollama') OR starts_with(lower(m), 'local:') OR contains(lower(m), ':local') THEN 0.0::DOUBLE " + " ".join(f"WHEN contains(lower(m), '{k}') THEN {v}::DOUBLE" for k, v in text.PRICES.items()) + " END"


def _usage(spark, sf):
    model = F.try_element_at(F.array(*map(F.lit, MODELS)), (F.col("c_custkey") % len(MODELS) + 1).cast("int"))
    used = (F.col("c_custkey") * 977 % 200_000).alias("used")
    return base.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment", model.alias("m"), used)


SQL_USAGE = f"WITH u AS (SELECT c_custkey, c_name, c_mktsegment, {_MODEL} AS m, c_custkey * 977 % 200000 AS used FROM customer), p AS (SELECT *, {_PRICE} AS price FROM u)"


@query("price_cost", SQL_USAGE + """ SELECT c_custkey, price, round(CASE WHEN used <= 0 THEN 0 ELSE used / 1e6::DOUBLE * price END, 9) AS usd, least(1.0::DOUBLE, greatest(0.0, used / 128000.0::DOUBLE)) AS share, (length(c_name) + length(m)) // 4 AS tokens FROM p""")
def price_cost(spark, sf):
    m, used = F.col("m"), F.col("used")
    return _usage(spark, sf).select("c_custkey", text.price_per_million(m).alias("price"), F.round(text.cost(used, m), 9).alias("usd"), text.window_fraction(used).alias("share"), text.estimated_tokens(F.col("c_name"), m).alias("tokens"))


@query("format_cost", SQL_USAGE + """, c AS (SELECT c_custkey, used / 1e4::DOUBLE * price / 100 AS usd FROM p)
SELECT c_custkey, CASE WHEN usd IS NULL THEN 'cost n/a' WHEN usd = 0 THEN '$0' WHEN usd < 0.01 THEN printf('$%.4f', usd) WHEN usd < 1 THEN printf('$%.3f', usd) ELSE printf('$%.2f', usd) END AS cost FROM c""")
def format_cost(spark, sf):
    usd = F.col("used") / 1e4 * text.price_per_million(F.col("m")) / 100
    return _usage(spark, sf).select("c_custkey", text.cost_text(usd).alias("cost"))


@query("usage_merge", SQL_USAGE + """ SELECT c_mktsegment, sum(used) AS tokens, count(*) AS calls, CASE WHEN count(DISTINCT s) > 1 THEN 'mixed' ELSE any_value(s) END AS source FROM (SELECT *, CASE WHEN price IS NULL THEN 'estimate' ELSE 'api' END AS s FROM p) GROUP BY c_mktsegment""")
def usage_merge(spark, sf):
    rows = _usage(spark, sf).withColumn("s", F.when(text.price_per_million(F.col("m")).isNull(), "estimate").otherwise("api"))
    return rows.groupBy("c_mktsegment").agg(F.sum("used").alias("tokens"), F.count("*").alias("calls"), F.when(F.countDistinct("s") > 1, "mixed").otherwise(F.first("s")).alias("source"))


@query("small_strings", """WITH s AS (SELECT p_partkey, p_name, p_brand FROM part) SELECT p_partkey, substr(sha1(p_name), 1, 16) AS key, regexp_replace(p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ->-> 3,2' ELSE '' END, '\\s*->->\\s*[\\d,\\s]*$', '') AS bare,
'mem-' || coalesce(nullif(substr(regexp_replace(p_brand || '/' || p_name, '[^A-Za-z0-9_-]+', '-', 'g'), 1, 48), ''), 'default') AS namespace, CASE WHEN p_partkey % 3 = 0 THEN 'I don''t know.' ELSE p_name END AS answer, p_brand AS parsed,
array_to_string(list_sort(list_distinct([trim(p_name), p_brand])), '|') AS evidence FROM s""")
def small_strings(spark, sf):
    """Hash keys, marker removal, namespaces, abstention, answer parsing, evidence lists."""
    n, b, k = F.col("p_name"), F.col("p_brand"), F.col("p_partkey")
    return base.table(spark, sf, "part").select(
        "p_partkey", text.short_hash(n, 16).alias("key"), text.without_marker(F.concat(n, F.when(k % 2 == 0, " ->-> 3,2").otherwise(""))).alias("bare"),
        text.namespace(F.concat(b, F.lit("/"), n)).alias("namespace"), text.abstain_text(F.when(k % 3 == 0, " n/i ").otherwise(n)).alias("answer"),
        text.parsed_answer(F.concat(F.lit("Answer: no. Answer: "), b)).alias("parsed"), F.array_join(text.split_evidence(F.concat_ws("; ", n, b, n)), "|").alias("evidence"),
    )


@query("parse_datetime", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m') AS bucket, strftime(o_orderdate + INTERVAL 1 DAY, '%Y-%m-%d') AS next_day FROM orders")
def parse_datetime(spark, sf):
    """Dates written in five forms, parsed back."""
    d = F.col("o_orderdate").cast("timestamp_ntz")
    k = F.col("o_orderkey") % 5
    form = lambda f: F.date_format(d, f)
    written = F.when(k == 0, form("yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 1, form("yyyy/MM/dd (EEE) HH:mm")).when(k == 2, form("yyyy/MM/dd")).when(k == 3, form("yyyy-MM-dd HH:mm")).otherwise(form("yyyy-MM-dd"))
    ts = dates.parsed(F.col("w"))
    return base.table(spark, sf, "orders").select("o_orderkey", written.alias("w")).select("o_orderkey", dates.iso_seconds(ts).alias("iso"), dates.prompt_date(ts).alias("day"), dates.month_bucket(ts).alias("bucket"), dates.day_range(ts)["end"].cast("string").alias("next_day"))


@query("extract_years", "SELECT event_id, CASE WHEN event_id % 4 IN (1, 2) THEN strftime(date_trunc('year', ts), '%Y-%m-%d') WHEN event_id % 4 = 0 THEN strftime(date_trunc('year', ts), '%Y-%m-%d') END AS year_day FROM events")
def extract_years(spark, sf):
    from recollect.queries.facts import _questions

    return _questions(spark, sf).select("event_id", F.make_date(F.get(dates.years_in(F.col("question")), F.lit(0)), F.lit(1), F.lit(1)).cast("string").alias("year_day"))


# -- routing

_CUE = lambda cues: "len(list_filter(" + sql_list(cues) + ", lambda c: contains(lower(text), c))) > 0"
_DATE = "len(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_matches(w, " + _q(routing.DATE_WORD) + "))) > 0"
_CLASS = f"CASE WHEN {_CUE(routing.UPDATE_CUES)} THEN 'knowledge_update' WHEN {_CUE(routing.TEMPORAL_CUES)} OR {_DATE} THEN 'temporal' WHEN {_CUE(routing.COUNT_CUES)} THEN 'aggregation' ELSE 'general' END"
_ASKED = f"""asked AS (SELECT conv_id, turn, text || {sql_list(['', ' how many', ' what has changed', ' when in May 2021', ' please recommend one', ' you told me', ' summarize it', ' list all'])}[conv_id % 8 + 1] AS text FROM conversations)"""
TAILS = ["", " how many", " what has changed", " when in May 2021", " please recommend one", " you told me", " summarize it", " list all"]


def _asked(spark, sf):
    tail = F.try_element_at(F.array(*map(F.lit, TAILS)), (F.col("conv_id") % 8 + 1).cast("int"))
    return base.table(spark, sf, "conversations").select("conv_id", "turn", F.concat("text", tail).alias("text"))


@query("route_query", f"WITH {_ASKED}, c AS (SELECT conv_id, turn, {_CLASS} AS class FROM asked) SELECT conv_id, turn, class, CASE WHEN class IN ('temporal', 'knowledge_update') THEN 'temporal' ELSE 'plain' END AS organization, class <> 'general' AS reasoning FROM c")
def route_query(spark, sf):
    t = F.col("text")
    c = routing.question_class(t)
    return _asked(spark, sf).select("conv_id", "turn", c.alias("class"), routing.organization(c).alias("organization"), routing.is_reasoning(t).alias("reasoning"))


@query("adaptive_depth", f"""WITH {_ASKED}, d AS (SELECT conv_id, turn, regexp_matches(text, {_q(routing.RECALL)}) OR regexp_matches(text, {_q(routing.BROAD)}) AS deep, {_CUE(routing.COUNT_CUES)} AS counting FROM asked)
SELECT conv_id, turn, CASE WHEN deep OR counting THEN 1.0::DOUBLE ELSE 0.3 END AS scan, CASE WHEN deep THEN 60 WHEN counting THEN 50 ELSE 20 END AS top_k FROM d""")
def adaptive_depth(spark, sf):
    return _asked(spark, sf).select("conv_id", "turn", routing.depth(F.col("text")).alias("d")).select("conv_id", "turn", "d.scan", "d.top_k")


@query("choose_reader", f"WITH {_ASKED} SELECT conv_id, turn, CASE WHEN regexp_matches(text, {_q(routing.ADVICE)}) THEN 'recommendation' WHEN {_CLASS} <> 'general' THEN 'reasoning' ELSE 'dated' END AS reader FROM asked")
def choose_reader(spark, sf):
    return _asked(spark, sf).select("conv_id", "turn", routing.reader(F.col("text")).alias("reader"))


@query("resolve_as_of", "SELECT c.c_custkey, coalesce(CASE WHEN c.c_custkey % 3 = 0 THEN '2000-01-01' END, strftime(max(o_orderdate), '%Y-%m-%d'), '1999-12-31') AS as_of FROM customer c LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c.c_custkey")
def resolve_as_of(spark, sf):
    """An explicit date, else the latest fact's, else a given day."""
    latest = base.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.date_format(F.max("o_orderdate").cast("timestamp_ntz"), "yyyy-MM-dd").alias("latest"))
    explicit = F.when(F.col("c_custkey") % 3 == 0, "2000-01-01")
    return base.table(spark, sf, "customer").select("c_custkey").join(latest, "c_custkey", "left").select("c_custkey", F.coalesce(explicit, "latest", F.lit("1999-12-31")).alias("as_of"))


# -- evaluation


@query("kendall_tau_b", """WITH r AS (SELECT o_custkey, o_orderkey AS item, o_orderdate AS x, CAST(o_totalprice AS BIGINT) // 50000 AS y FROM orders),
p AS (SELECT a.o_custkey, sign(epoch(a.x) - epoch(b.x)) AS sx, sign(a.y - b.y) AS sy FROM r a JOIN r b ON a.o_custkey = b.o_custkey AND a.item < b.item), s AS (SELECT o_custkey, sum(sx * sy) AS s, sum(sx * sx) AS ux, sum(sy * sy) AS uy FROM p GROUP BY o_custkey),
t AS (SELECT o_custkey, CASE WHEN ux = 0 OR uy = 0 THEN 0.0::DOUBLE ELSE s / sqrt(CAST(ux * uy AS DOUBLE)) END AS tau FROM s) SELECT o_custkey, round(tau, 6) AS tau, round((tau + 1) / 2, 6) AS tau_norm FROM t""")
def kendall_tau_b(spark, sf):
    ranks = base.table(spark, sf, "orders").select("o_custkey", F.col("o_orderkey").alias("item"), F.unix_timestamp("o_orderdate").alias("x"), F.floor(F.round("o_totalprice").cast("long") / 50000).alias("y"))
    return evaluation.tau_b(ranks, "o_custkey")


@query("beam_agg", """WITH c AS (SELECT lang AS category, source AS conversation, CAST(quality AS DOUBLE) - toxic / 2.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id)), a AS (SELECT conversation, category, avg(score) AS s FROM c GROUP BY ALL), b AS (SELECT category, avg(s) AS score FROM a GROUP BY category)
SELECT category, round(score, 6) AS score FROM b UNION ALL SELECT 'average', round(avg(score), 6) FROM b""")
def beam_agg(spark, sf):
    rows = base.table(spark, sf, "labels").join(base.table(spark, sf, "documents"), "doc_id").select(F.col("lang").alias("category"), F.col("source").alias("conversation"), (F.col("quality") - F.col("toxic") / 2.0).alias("score"))
    return evaluation.staged_means(rows)


@query("acc_by_ability", """WITH c AS (SELECT lang AS ability, CAST(quality AS DOUBLE) - toxic / 2.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))
SELECT ability, count(*) AS n, round(avg(CASE WHEN score >= 0.7 THEN 1.0::DOUBLE ELSE 0 END), 6) AS accuracy, round(avg(score), 6) AS mean_score FROM c GROUP BY ROLLUP (ability)""")
def acc_by_ability(spark, sf):
    rows = base.table(spark, sf, "labels").join(base.table(spark, sf, "documents"), "doc_id").select(F.col("lang").alias("ability"), (F.col("quality") - F.col("toxic") / 2.0).alias("score"))
    return evaluation.accuracy(rows, "ability")


# -- record sources


@query("record_to_text", """SELECT o_orderkey, 'o_orderkey: ' || o_orderkey || '; o_custkey: ' || o_custkey || '; o_orderstatus: ' || o_orderstatus || '; o_orderpriority: ' || o_orderpriority AS line FROM orders""")
def record_to_text(spark, sf):
    from recollect.sources.records import record_text

    return base.table(spark, sf, "orders").withColumn("note", F.when(F.col("o_orderkey") % 2 == 0, "")).select("o_orderkey", record_text(["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "note"]).alias("line"))


@query("src_records", """WITH n AS (SELECT o_custkey, o_orderkey, o_orderdate, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) // 20 AS session FROM orders)
SELECT o_custkey, session, count(*) AS turns, strftime(arg_min(o_orderdate, o_orderkey), '%Y-%m-%d') AS day FROM n GROUP BY o_custkey, session""")
def src_records(spark, sf):
    """A customer's records as sessions of 20, dated by their first record."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    n = base.table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.floor((F.row_number().over(w) - 1) / 20).alias("session"))
    return n.groupBy("o_custkey", "session").agg(F.count("*").alias("turns"), F.date_format(F.min_by("o_orderdate", "o_orderkey").cast("timestamp_ntz"), "yyyy-MM-dd").alias("day"))


@query("find_date", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events")
def find_date(spark, sf):
    """The first dated field of JSON records: ISO text, or an epoch in seconds or milliseconds."""
    from recollect.sources.records import record_date

    ts = F.col("ts").cast("timestamp_ntz")
    seconds = F.unix_timestamp(F.col("ts"))
    k = F.col("event_id") % 3
    record = F.when(k == 0, F.to_json(F.struct(F.lit("x").alias("date"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("time")))).when(k == 1, F.to_json(F.struct(seconds.alias("created_at")))).otherwise(F.to_json(F.struct((seconds * 1000).alias("timestamp"))))
    return base.table(spark, sf, "events").select("event_id", "ts", record.alias("record")).select("event_id", record_date(F.col("record")).alias("day"))


@query("chunk_document")
def chunk_document(spark, sf):
    """Documents as pseudo-sessions of eight paragraphs; long paragraphs are cut at sentence ends (an iterative rule: no SQL)."""
    from recollect.sources.files import chunked

    return chunked(base.table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("name"), F.col("text").alias("body"))).groupBy("name", "session").agg(F.count("*").alias("turns"), F.sum(F.length("content")).alias("chars"))
