"""Changes to a fact table as plans from old rows to new rows: upsert, supersession, deletion, source groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upserted(bank: DataFrame, batch: DataFrame) -> DataFrame:
    """The batch's rows to append: ids that are neither in the bank nor earlier in the batch (by pos)."""
    return firsts(batch).join(bank.select("fact_id"), "fact_id", "left_anti")


def firsts(facts: DataFrame) -> DataFrame:
    """The first row by pos of each fact_id. Copies of a very common fact fall together in each task before any shuffle."""
    rest = [c for c in facts.columns if c != "fact_id"]
    return facts.groupBy("fact_id").agg(F.min_by(F.struct(*rest), "pos").alias("_first")).select("fact_id", "_first.*").select(facts.columns)


def existing_ids(bank: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("fact_id").distinct().join(bank.select("fact_id"), "fact_id", "left_semi")


def superseded(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """facts with superseded_by and valid_to set by (old_id, new_id, valid_to)."""
    marks = pairs.select(F.col("old_id").alias("_old"), F.col("new_id").alias("_new"), F.col("valid_to").alias("_to"))
    out = facts.join(marks, F.col("fact_id") == F.col("_old"), "left")
    return out.withColumns({"superseded_by": F.coalesce("_new", "superseded_by"), "valid_to": F.coalesce("_to", "valid_to")}).select(facts.columns)


def valid_until(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """facts with valid_to set by (fact_id, until), whatever it was."""
    marks = ids.select(F.col("fact_id").alias("_id"), F.col("until").alias("_until"))
    out = facts.join(marks, F.col("fact_id") == F.col("_id"), "left")
    return out.withColumn("valid_to", F.when(F.col("_id").isNotNull(), F.col("_until")).otherwise(F.col("valid_to"))).select(facts.columns)


def deleted(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """facts without ids; what a deleted fact had closed is open again."""
    gone = ids.select(F.col("fact_id").alias("_gone")).distinct()
    left = facts.join(gone, F.col("fact_id").cast("string") == F.col("_gone").cast("string"), "left_anti")
    marked = left.join(gone, F.col("superseded_by") == F.col("_gone").cast("string"), "left")
    lost = F.col("_gone").isNotNull()
    return marked.withColumns({"superseded_by": F.when(lost, "").otherwise(F.col("superseded_by")), "valid_to": F.when(~lost, F.col("valid_to"))}).select(facts.columns)


KEY = ["doc_id", "source_session", "source_ref"]


def orphaned_sources(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """Verbatim rows whose source a deleted atomic fact used and no remaining one uses."""
    atomics = facts.where("kind = 'atomic'")
    doomed = atomics.join(ids.select("fact_id"), "fact_id", "left_semi").select(KEY).distinct()
    alive = atomics.join(ids.select("fact_id"), "fact_id", "left_anti").select(KEY).distinct()
    return facts.where("kind = 'verbatim'").join(doomed.join(alive, KEY, "left_anti"), KEY, "left_semi")


def source_group(facts: DataFrame, ids: DataFrame) -> DataFrame:
    """All rows of both lanes from the sources of ids; a session's own reference owns its turns'."""
    keys = facts.join(ids.select("fact_id"), "fact_id", "left_semi").select(KEY).distinct()
    exact = facts.join(keys, KEY, "left_semi")
    # a turn's reference starts with its session's: cut it there and the prefix match is an equality
    whole = keys.select("doc_id", "source_session", F.col("source_ref").alias("_owner"))
    owned = facts.withColumn("_owner", F.substring_index("source_ref", "/turn:", 1)).join(whole, ["doc_id", "source_session", "_owner"], "left_semi")
    return exact.unionByName(owned.select(facts.columns)).dropDuplicates(["fact_id"])


def resolved(facts: DataFrame, refs: DataFrame) -> DataFrame:
    """(ref, n, fact_id): each reference (a whole id, or ``mem:`` and an id's first 12 characters) with the number of facts it names
    and the fact if it is one."""
    head = F.when(F.startswith("ref", F.lit("mem:")), F.substring("ref", 5, 12)).otherwise(F.substring("ref", 1, 12))
    asked = refs.select("ref", head.alias("_head"))
    known = facts.select("fact_id", F.substring("fact_id", 1, 12).alias("_head"))
    hit = F.col("fact_id").isNotNull() & (F.startswith("ref", F.lit("mem:")) | (F.col("ref") == F.col("fact_id")))
    found = asked.join(known, "_head", "left").groupBy("ref").agg(F.count_if(hit).alias("n"), F.min(F.when(hit, F.col("fact_id"))).alias("fact_id"))
    return found.withColumn("fact_id", F.when(F.col("n") == 1, F.col("fact_id")))
