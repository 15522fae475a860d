"""The fact table and its lanes over stored conversations; orders as a value that changes per customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recollect.functions import dates, text
from recollect.operators import mutations

FACT_COLUMNS = ["fact_id", "pos", "kind", "text", "ts", "subject", "entities", "time_bucket", "doc_id", "source_session", "source_ref", "source_speaker"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, turn, role, content, day): every stored turn; a conversation has one date, some have none."""
    day = F.when(F.col("conv_id") % 11 != 3, F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.col("text").alias("content"), day.alias("day"))


def verbatim(turn_rows: DataFrame) -> DataFrame:
    """One fact per turn that isn't blank, in every role."""
    body = F.trim(F.coalesce("content", F.lit("")))
    return _facts(turn_rows.withColumn("body", body).where("body <> ''").withColumn("n", F.lit(0)), "verbatim")


def atomic(turn_rows: DataFrame, least: int = 4) -> DataFrame:
    """The default distiller: a fact per sentence of a user's turn, of at least `least` characters."""
    said = turn_rows.where("role = 'user'").select("*", F.posexplode(F.split("content", r"[.\n]+")).alias("n", "part"))
    return _facts(said.withColumn("body", F.trim("part")).where(F.length("body") >= least), "atomic")


def _facts(rows: DataFrame, kind: str) -> DataFrame:
    day = F.coalesce(F.col("day").cast("string"), F.lit(""))
    session = F.concat(F.lit("session:"), F.col("conv_id"))
    return rows.select(
        text.content_id(F.col("body"), F.lit(""), day, F.lit(kind)).alias("fact_id"),
        ((F.col("conv_id") * 1000 + F.col("turn")) * 1000 + F.col("n")).alias("pos"),
        F.lit(kind).alias("kind"), F.col("body").alias("text"), F.col("day").cast("timestamp_ntz").alias("ts"), F.lit("").alias("subject"),
        text.entities(F.col("body")).alias("entities"), dates.month_bucket(F.col("day")).alias("time_bucket"),
        F.concat(F.lit("doc:"), F.col("conv_id") % 10).alias("doc_id"), session.alias("source_session"),
        F.concat(session, F.lit("/turn:"), F.col("turn")).alias("source_ref"), F.col("role").alias("source_speaker"),
    )


def first_of_each(facts: DataFrame) -> DataFrame:
    """The first row by position of each fact_id."""
    return mutations.firsts(facts)


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both lanes, each identity once."""
    rows = turns(spark, sf_dir)
    return first_of_each(verbatim(rows).unionByName(atomic(rows)))


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as dated facts of a customer; each closes the one before it."""
    following = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").alias("subject"), F.col("o_orderdate").cast("timestamp_ntz").alias("ts"), F.col("o_orderstatus").alias("value"),
        F.coalesce(F.lead("o_orderkey").over(following).cast("string"), F.lit("")).alias("superseded_by"), F.lead(F.col("o_orderdate").cast("timestamp_ntz")).over(following).alias("valid_to"),
    )


# The same in DuckDB.
SQUEEZED = "trim(regexp_replace({0}, '\\s+', ' ', 'g'))"
NAMES = "list_transform(list_filter(regexp_extract_all({0}, '[\\p{{L}}\\p{{N}}_]+'), lambda w: regexp_full_match(w, '[A-Z][a-zA-Z]+')), lambda w: lower(w))"


def sql_list(values) -> str:  # noqa: ANN001
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_entities(column: str) -> str:
    names = f"list_filter({NAMES.format(column)}, lambda w: NOT list_contains({sql_list(text.STOP_CAPS)}, w))"
    aliases = f"map({sql_list(text.KIN_ALIASES)}, {sql_list(text.KIN_ALIASES.values())})"
    kin = f"list_filter(list_transform(regexp_extract_all(lower({column}), '[a-z0-9'']+'), lambda w: coalesce({aliases}[w], w)), lambda w: list_contains({sql_list(text.KIN_TERMS)}, w))"
    return f"list_sort(list_distinct(list_concat({names}, {kin})))"


SQL_TURNS = """turns AS (SELECT conv_id, turn, role, text AS content,
  CASE WHEN conv_id % 11 <> 3 THEN DATE '2024-01-01' + CAST(conv_id AS INTEGER) END AS day FROM conversations)"""
_SQL_LANE = """{kind}_rows AS (SELECT {identity} AS fact_id,
  (conv_id * 1000 + turn) * 1000 + n AS pos, '{kind}' AS kind, body AS text, CAST(day AS TIMESTAMP) AS ts, '' AS subject, {entities} AS entities,
  coalesce(strftime(day, '%Y-%m'), 'unknown') AS time_bucket, 'doc:' || (conv_id % 10) AS doc_id, 'session:' || conv_id AS source_session,
  'session:' || conv_id || '/turn:' || turn AS source_ref, role AS source_speaker FROM ({rows}))"""
_SQL_KEY = "'' || chr(31) || coalesce(CAST(day AS VARCHAR), '') || chr(31) || " + SQUEEZED.format("lower(body)")
SQL_FACTS = ",\n".join([
    "WITH " + SQL_TURNS,
    _SQL_LANE.format(kind="verbatim", identity=f"substr(sha1('verbatim' || chr(31) || {_SQL_KEY}), 1, 32)", entities=sql_entities("body"), rows="SELECT *, 0 AS n, trim(coalesce(content, '')) AS body FROM turns WHERE trim(coalesce(content, '')) <> ''"),
    _SQL_LANE.format(kind="atomic", identity=f"substr(sha1({_SQL_KEY}), 1, 32)", entities=sql_entities("body"), rows="SELECT * FROM (SELECT *, trim(part) AS body FROM (SELECT t.*, unnest(regexp_split_to_array(content, '[.\\n]+')) AS part, generate_subscripts(regexp_split_to_array(content, '[.\\n]+'), 1) - 1 AS n FROM turns t WHERE role = 'user')) WHERE length(body) >= 4"),
    "facts AS (SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY fact_id ORDER BY pos) AS k FROM (SELECT * FROM verbatim_rows UNION ALL SELECT * FROM atomic_rows)) WHERE k = 1)",
])
SQL_ORDERS = """WITH order_facts AS (SELECT o_orderkey AS fact_id, o_custkey AS subject, o_orderdate AS ts, o_orderstatus AS value,
  coalesce(CAST(lead(o_orderkey) OVER w AS VARCHAR), '') AS superseded_by, lead(o_orderdate) OVER w AS valid_to
  FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"""
