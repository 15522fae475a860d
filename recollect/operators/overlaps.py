"""How many sets of a table share an element with each of many other sets, without a row per pair.

Elements that more than ``RARE`` sets hold are common: at most ``COMMON`` of them, numbered by the driver. Sets reached over a
common element are counted on distinct patterns of common elements, with their numbers as weights, by unions of bit rows in
blocks of bounded size. Rare elements are joined, which makes at most that many rows an element, and of these only sets count
that no common element reaches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.plans.shared import cut

#: Sets that hold an element up to which it is joined; larger tables have a larger bound, so that no more than COMMON
#: elements are above it.
RARE, COMMON = 256, 1 << 16
#: Patterns a block of either side, sets whose bits are held at once, and words of a step.
ASKED_BLOCK, HELD_BLOCK, CHUNK, WORDS = 1 << 14, 1 << 16, 1 << 14, 1 << 17


def reached(asked: DataFrame, held: DataFrame, rare: int = RARE, asked_block: int = ASKED_BLOCK, held_block: int = HELD_BLOCK) -> DataFrame:
    """(es, items, groups): for each distinct set of asked (es), how many rows of held (grp, es) share an element with it, and
    how many distinct groups these have (a null group is none); sets that reach nothing are left out. es: arrays of distinct
    strings, sorted in asked."""
    counts = cut(held.select(F.explode("es").alias("e")).where("e is not null").groupBy("e").agg(F.count("*").alias("n")))
    limit = max(rare, (counts.agg(F.sum("n")).head()[0] or 0) // COMMON)
    common = counts.where(F.col("n") > limit).select("e").toArrow().column("e").combine_chunks()
    shared = held.sparkSession.sparkContext.broadcast(common)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            codes = pc.index_in(lists.flatten(), value_set=shared.value)
            owner, known = pc.list_parent_indices(lists), pc.is_valid(codes)
            parts = []
            for values, mask in ((codes, known), (lists.flatten(), pc.invert(known))):
                own = np.bincount(pc.filter(owner, mask).to_numpy(), minlength=len(batch)) if len(batch) else np.zeros(0, np.int64)
                parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(own)]).astype(np.int32)), pc.filter(values, mask)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *parts], [*batch.schema.names, "common", "rare"])

    sets = cut(asked.select("es").distinct().mapInArrow(coded, "es array<string>, common array<int>, rare array<string>").withColumn("q", F.monotonically_increasing_id()))
    kind = held.schema["grp"].dataType.simpleString()
    items = cut(held.select("grp", "es").mapInArrow(coded, f"grp {kind}, es array<string>, common array<int>, rare array<string>").drop("es").withColumn("item", F.monotonically_increasing_id()))
    sort = F.array_sort("common").alias("common")
    groups = cut(items.where("grp is not null").select("grp", F.explode("common").alias("c")).groupBy("grp").agg(F.array_sort(F.collect_set("c")).alias("common")))

    patterns = sets.where("size(common) > 0").select(sort).distinct()
    by_items = _weights(patterns, items.where("size(common) > 0").groupBy(sort).agg(F.count("*").alias("n")), asked_block, held_block)
    by_groups = _weights(patterns, groups.groupBy("common").agg(F.count("*").alias("n")), asked_block, held_block)

    postings = items.select("item", "grp", "common", F.explode("rare").alias("e")).join(groups.withColumnRenamed("common", "group_common"), "grp", "left")
    pairs = sets.select("q", F.col("common").alias("own"), F.explode("rare").alias("e")).join(postings, "e")
    fresh = ~F.arrays_overlap("own", "common")
    fresh_group = F.col("grp").isNotNull() & ~F.coalesce(F.arrays_overlap("own", "group_common"), F.lit(False))
    once = pairs.groupBy("q", "grp", "item").agg(F.first(fresh).alias("i"), F.first(fresh_group).alias("g"))
    each = once.groupBy("q", "grp").agg(F.count_if("i").alias("items"), F.first("g").alias("g"))
    over_rare = each.groupBy("q").agg(F.sum("items").alias("rare_items"), F.count_if("g").alias("rare_groups"))

    keyed = sets.select("es", "q", sort)
    out = keyed.join(by_items.withColumnRenamed("n", "i"), "common", "left").join(by_groups.withColumnRenamed("n", "g"), "common", "left").join(over_rare, "q", "left")
    total = lambda a, b: F.coalesce(F.col(a), F.lit(0)) + F.coalesce(F.col(b), F.lit(0))
    return out.select("es", total("i", "rare_items").alias("items"), total("g", "rare_groups").alias("groups")).where("items > 0")


def _weights(asked: DataFrame, held: DataFrame, asked_block: int, held_block: int) -> DataFrame:
    """(common, n): for each pattern of asked (common), the weights of the patterns of held (common, n) that share a number."""
    asked, held = cut(asked), cut(held)
    xs, ys = max(1, -(-asked.count() // asked_block)), max(1, -(-held.count() // held_block))
    block = lambda n: F.pmod(F.xxhash64("common"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.select("common", block(xs).alias("x"), every(ys).alias("y")).groupBy("x", "y")
    right = held.select("common", "n", every(xs).alias("x"), block(ys).alias("y")).groupBy("x", "y")
    return left.cogroup(right).applyInArrow(_united, "common array<int>, n long").groupBy("common").agg(F.sum("n").alias("n"))


def _united(asked: pa.Table, held: pa.Table) -> pa.Table:
    total = np.zeros(len(asked), np.int64)
    if len(asked) and len(held):
        lists, own = asked.column("common").combine_chunks(), held.column("common").combine_chunks()
        weights = held.column("n").to_numpy()
        order = np.argsort(-weights, kind="stable")  # so that most chunks are of the weight 1 alone
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        values, at = own.flatten().to_numpy(), place[pc.list_parent_indices(own).to_numpy()]
        known, row = np.unique(values, return_inverse=True)
        flat, lengths = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
        near = np.minimum(np.searchsorted(known, flat), len(known) - 1)
        rows = np.where(known[near] == flat, near, len(known))  # the last row is empty
        starts = np.cumsum(lengths) - lengths
        sizes = [(k, np.flatnonzero(lengths == k)) for k in np.unique(lengths)]
        for low in range(0, len(order), CHUNK):
            n = min(CHUNK, len(order) - low)
            words = -(-n // 64)
            inside = (at >= low) & (at < low + n)
            bits = np.zeros((len(known) + 1, words), np.uint64)
            spot = at[inside] - low
            np.bitwise_or.at(bits, (row[inside], spot // 64), np.uint64(1) << (spot % 64).astype(np.uint64))
            w = np.zeros(words * 64, np.int64)
            w[:n] = weights[order[low : low + n]]
            planes = [(b, np.packbits((w >> b & 1).astype(np.uint8), bitorder="little").view(np.uint64)) for b in range(int(w.max()).bit_length())]
            step = max(1, WORDS // words)
            for k, picks in sizes:
                for a in range(0, len(picks), step):
                    pick = picks[a : a + step]
                    union = bits[rows[starts[pick]]]
                    for j in range(1, k):
                        union |= bits[rows[starts[pick] + j]]
                    for b, plane in planes:
                        total[pick] += np.bitwise_count(union & plane).sum(axis=1, dtype=np.int64) << b
    return pa.table({"common": asked.column("common"), "n": pa.array(total, pa.int64())})
