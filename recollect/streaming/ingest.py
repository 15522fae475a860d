"""Incremental ingest: files of turns arrive, each micro-batch appends the facts whose identity is new."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from recollect.operators.mutations import upserted
from recollect.plans import base

TURNS = "conv_id long, turn long, role string, text string"


def stored(spark: SparkSession, bank: str, schema) -> DataFrame:  # noqa: ANN001
    """The bank's rows; an empty table before the first batch."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(bank)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(bank)


def dated(turn_rows: DataFrame) -> DataFrame:
    day = F.when(F.col("conv_id") % 11 != 3, F.date_add(F.lit("2024-01-01").cast("date"), F.col("conv_id").cast("int")))
    return turn_rows.select("conv_id", "turn", "role", F.col("text").alias("content"), day.alias("day"))


def ingest(spark: SparkSession, source: str, bank: str, checkpoint: str, files_per_batch: int = 1000):  # noqa: ANN201
    """Start a query that has read all present files when it ends; running it again reads only new ones.

    A batch that is repeated after a failure appends nothing new, as its ids are in the bank by then; a batch's own folder is
    overwritten, so half-written output of a lost attempt doesn't stay."""
    turns = spark.readStream.schema(TURNS).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def store(batch: DataFrame, number: int) -> None:
        rows = dated(batch)
        facts = base.verbatim(rows).unionByName(base.atomic(rows))
        others = stored(spark, bank, StructType([*facts.schema.fields, StructField("batch", LongType())])).where(F.col("batch") != number)
        new = upserted(others, facts).withColumn("batch", F.lit(number).cast("long"))
        new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(bank)

    return turns.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events per type and tumbling window, for streams and tables alike."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a user's events with no longer gap."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("start"), "user_id", "n")
