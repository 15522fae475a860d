"""BM25 over postings, and lexical attribution of facts to turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.functions import text
from recollect.plans.shared import cut

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Rows of (query, token, weight) that are broadcast; beyond it they are joined by shuffles.
ASKED = 1 << 20


def vocabulary(words: DataFrame) -> DataFrame:
    """(token, n, length) of (id, tokens, dl): documents that hold a token; the row with a null token has their number and the
    sum of their lengths. One pass; partial counts by token."""
    each = words.select("dl", F.explode(F.concat(F.array_distinct("tokens"), F.array(F.lit(None).cast("string")))).alias("token"))
    return each.groupBy("token").agg(F.count("*").alias("n"), F.sum("dl").alias("length"))


def bm25(docs: DataFrame, queries: DataFrame, k: int, positive: bool = True) -> DataFrame:
    """(query_id, id, score, place): the k best positive scores per query (ties by id); repeated query tokens count again.
    positive=False keeps all documents that share a token: in a bank of a few rows no idf is above zero.

    ids are distinct; an empty document has one sentinel token that no query has. An idf is ln((N - n + 0.5)/(n + 0.5)), and
    EPSILON times the vocabulary's mean where that is negative. Documents are read twice: for the vocabulary, and for the
    counts of asked tokens, which meet the asked ones before they are shuffled while these are few enough to broadcast."""
    found = text.tokens(F.col("body"))
    words = docs.select("id", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("\x00"))).alias("tokens")).withColumn("dl", F.size("tokens"))
    vocab = cut(vocabulary(words))
    whole = vocab.where("token is null").head()
    n_docs, mean_dl = (whole["n"], whole["length"] / whole["n"]) if whole else (0, 1.0)
    raw = vocab.where("token is not null").select("token", (F.ln(F.lit(n_docs) - F.col("n") + 0.5) - F.ln(F.col("n") + 0.5)).alias("idf"))
    mean = raw.agg(F.avg("idf")).head()[0] or 0.0
    asked = queries.select("query_id", F.explode(text.tokens(F.col("body"))).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("qf"))
    weighted = cut(asked.join(raw, "token").select("query_id", "token", (F.col("qf") * F.when(F.col("idf") < 0, EPSILON * mean).otherwise(F.col("idf"))).alias("weight")))
    small = F.broadcast if weighted.count() <= ASKED else lambda rows: rows
    held = words.select("id", "dl", F.explode("tokens").alias("token")).join(small(weighted.select("token").distinct()), "token", "left_semi")
    counts = held.groupBy("id", "token").agg(F.count("*").alias("tf"), F.max("dl").alias("dl"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / mean_dl))
    scored = counts.join(small(weighted), "token").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"))
    scored = scored.where("score > 0") if positive else scored
    place = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def matched_turns(facts: DataFrame, turns: DataFrame) -> DataFrame:
    """(fact_id, turn, score): the turn of a fact's session that shares most of its content tokens, each weighted by one over
    the session's turns that have it; the earliest on ties; no row without a shared token.

    facts: (fact_id, session, body); turns: (session, turn, body)."""
    f = facts.select("fact_id", "session", F.explode(text.content_tokens(F.col("body"))).alias("token"))
    t = turns.select("session", "turn", F.explode(text.content_tokens(F.col("body"))).alias("token"))
    rare = t.withColumn("df", F.count("*").over(Window.partitionBy("session", "token")))
    scored = f.join(rare, ["session", "token"]).groupBy("fact_id", "turn").agg(F.round(F.sum(1.0 / F.col("df")), 6).alias("score"))
    best = Window.partitionBy("fact_id").orderBy(F.desc("score"), "turn")
    return scored.withColumn("_k", F.row_number().over(best)).where("_k = 1").drop("_k")
