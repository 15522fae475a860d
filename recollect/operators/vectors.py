"""Vector operators: cosine search, centroids, routing under a scan budget, rank fusion, clustering, hashing encoder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.plans.shared import cut

#: Queries that are sent to the tasks at once; more go in further blocks.
QUERY_BLOCK = 4096
#: Queries of a block that are scored at once against a batch of the bank.
QUERY_ROWS = 256
#: Centroids that are sent to the tasks at once, in one row; more go in further rows.
CENTROID_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def unit(a: Column, least: float = 1e-8) -> Column:
    return F.transform(a, lambda x: x.cast("double") / (norm(a) + least))


def dense_topk(bank: DataFrame, queries: DataFrame, k: int, block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, id, cosine, place) of the k nearest per query (ties by id), from (id, vector) and (query_id, vector).

    A matrix product per bank batch and query block keeps the k best of the batch, so what is shuffled is k rows a query and
    batch. Query blocks are bounded; bank rows never move."""
    spark = bank.sparkSession
    blocks = max(1, -(-queries.count() // block))
    numbered = queries.withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    parts = []
    for b in range(blocks):
        rows = numbered.where(F.col("_b") == b).select("query_id", "vector").toArrow()
        ids = rows.column("query_id").to_numpy()
        matrix = np.array(rows.column("vector").to_pylist(), np.float64).reshape(len(ids), -1)
        shared = spark.sparkContext.broadcast((ids, matrix))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            ids, matrix = shared.value
            for batch in batches:
                if not len(batch) or not len(ids):
                    continue
                own = batch.column(0).to_numpy()
                vectors = np.array(batch.column(1).to_pylist(), np.float64)
                for a in range(0, len(ids), QUERY_ROWS):
                    scores = np.round(matrix[a : a + QUERY_ROWS] @ vectors.T, 6)
                    least = np.partition(scores, -k, axis=1)[:, -k] if k < len(own) else np.full(len(scores), -np.inf)
                    q, at = np.nonzero(scores >= least[:, None])  # ties with the k-th go along and are cut by id
                    order = np.lexsort((own[at], -scores[q, at], q))
                    q, at = q[order], at[order]
                    kept = np.arange(len(q)) - np.searchsorted(q, q) < k
                    q, at = q[kept], at[kept]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + q]), pa.array(own[at]), pa.array(scores[q, at])], ["query_id", "id", "cosine"])

        parts.append(bank.select(F.col("id").cast("long"), "vector").mapInArrow(run, "query_id long, id long, cosine double"))
    near = parts[0]
    for p in parts[1:]:
        near = near.unionByName(p)
    place = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return near.withColumn("place", F.row_number().over(place)).where(F.col("place") <= k)


def centroids(rows: DataFrame) -> DataFrame:
    """(bucket, size, centroid): normalised component-wise means of (bucket, vector)."""
    parts = rows.select("bucket", F.posexplode("vector").alias("i", "x"))
    means = parts.groupBy("bucket", "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    packed = means.groupBy("bucket").agg(F.max("n").alias("size"), F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return packed.select("bucket", "size", unit(F.transform("p", lambda x: x["m"])).alias("centroid"))


def _similarities(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """rows with `near`: (similarity, -bucket, size) of every centroid. A row carries its centroids as arrays of at most
    CENTROID_BLOCK, so nothing is paired and nothing is shuffled by row. cents is read twice: cut it first if it is costly."""
    blocks = max(1, -(-cents.count() // CENTROID_BLOCK))
    parts = []
    for b in range(blocks):
        own = cents.where(F.pmod(F.xxhash64("bucket"), F.lit(blocks)) == b)
        rows = rows.join(F.broadcast(own.agg(F.collect_list(F.struct("bucket", "size", "centroid")).alias(f"_c{b}"))), F.lit(True))
        parts.append(F.transform(f"_c{b}", lambda c: F.struct(F.round(dot(F.col("vector"), c["centroid"]), 6).alias("similarity"), (-c["bucket"]).alias("minus"), c["size"].alias("size"))))
    return rows.withColumn("near", F.concat(*parts)).drop(*[f"_c{b}" for b in range(blocks)])


def route(queries: DataFrame, cents: DataFrame, temperature: float = 0.1) -> DataFrame:
    """(query_id, bucket, size, similarity, probability): every query against the centroids, a softmax within the query's row."""
    near = _similarities(queries.select("query_id", "vector"), cut(cents)).select("query_id", "near", F.array_max("near")["similarity"].alias("_m"))
    weighted = near.select("query_id", F.transform("near", lambda c: F.struct(c.alias("c"), F.exp((c["similarity"] - F.col("_m")) / temperature).alias("w"))).alias("near"))
    total = F.aggregate("near", F.lit(0.0), lambda t, c: t + c["w"])
    rows = weighted.select("query_id", total.alias("_t"), F.explode("near").alias("n"))
    return rows.select("query_id", (-F.col("n.c.minus")).alias("bucket"), "n.c.size", "n.c.similarity", F.round(F.col("n.w") / F.col("_t"), 6).alias("probability"))


def opened(routed: DataFrame, budget: float, exclude: tuple[int, ...] = ()) -> DataFrame:
    """The buckets that a scan budget opens: by falling similarity while the rows before a bucket are under the target."""
    left = routed.where(~F.col("bucket").isin(*exclude)) if exclude else routed
    own = Window.partitionBy("query_id")
    by = own.orderBy(F.desc("similarity"), "bucket")
    target = F.greatest(F.lit(1), F.ceil(F.lit(budget) * F.sum("size").over(own)))
    before = F.sum("size").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    return left.where("size > 0").withColumns({"_t": target, "_b": before, "place": F.row_number().over(by)}).where("_b < _t").drop("_t", "_b")


def reciprocal_ranks(pool: DataFrame, signals: list[str], key: str = "id", constant: int = 60) -> DataFrame:
    """The pool with `fused`: the sum over signals of 1/(constant + rank), rank from 0 by falling signal, ties by key."""
    total = F.lit(0.0)
    for s in signals:
        total = total + F.lit(1.0) / (constant + F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(s), key)) - 1)
    return pool.withColumn("fused", F.round(total, 9))


def _nearest(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """rows with the bucket and similarity of the nearest centroid, the lowest bucket on ties."""
    best = _similarities(rows, cents).withColumn("near", F.array_max("near")).where("near is not null")
    return best.withColumns({"bucket": -F.col("near.minus"), "similarity": F.col("near.similarity")}).drop("near")


def assigned(rows: DataFrame, cents: DataFrame) -> DataFrame:
    """(id, bucket, similarity): the nearest centroid of each vector, the lowest bucket on ties."""
    return _nearest(rows.select("id", "vector"), cents).select("id", "bucket", "similarity")


def cluster_count(n: int, k: int) -> int:
    return max(2, min(k, n // 3)) if n >= 6 else 1


def lloyd(rows: DataFrame, k: int, rounds: int = 3) -> tuple[DataFrame, DataFrame]:
    """(assignments, centroids) of a deterministic k-means: seeds are the k rows with the least sha1 of their id; an empty
    cluster keeps its centroid. A round is one map against the centroids, one aggregation, and a cut of its small result."""
    seeds = rows.orderBy(F.sha1(F.col("id").cast("string"))).limit(k).select("id", "vector")
    cents = seeds.withColumn("bucket", F.row_number().over(Window.orderBy(F.sha1(F.col("id").cast("string")))) - 1).select("bucket", F.lit(0).cast("long").alias("size"), unit(F.col("vector")).alias("centroid"))
    for _ in range(rounds):
        cents = cut(cents)
        new = centroids(_nearest(rows.select("vector"), cents).select("bucket", "vector"))
        kept = cents.select("bucket", F.col("centroid").alias("_old")).join(new, "bucket", "left")
        cents = kept.select("bucket", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("centroid", "_old").alias("centroid"))
    cents = cut(cents)
    return assigned(rows, cents), cents


def hashed(rows: DataFrame, keys: list[str], tokens: Column, dim: int = 256) -> DataFrame:
    """(keys, i, v): the default encoder. Signed feature hashing of tokens, normalised, as sparse components."""
    digest = F.md5("token")
    parts = rows.select(*keys, F.explode(tokens).alias("token"))
    slot = (F.conv(F.substring(digest, 1, 4), 16, 10).cast("long") % dim).alias("i")
    sign = F.when(F.conv(F.substring(digest, 5, 1), 16, 10).cast("long") < 8, 1).otherwise(-1)
    sums = parts.select(*keys, slot, sign.alias("s")).groupBy(*keys, "i").agg(F.sum("s").alias("v")).where("v <> 0")
    length = F.sqrt(F.sum(F.col("v") * F.col("v")).over(Window.partitionBy(*keys)).cast("double"))
    return sums.withColumn("v", F.round(F.col("v") / length, 6))


def dense(parts: DataFrame, keys: list[str], dim: int = 256) -> DataFrame:
    """(keys, vector) from the sparse components of hashed()."""
    held = parts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"))
    return held.select(*keys, F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.try_element_at("m", i.cast("long")), F.lit(0.0))).alias("vector"))
