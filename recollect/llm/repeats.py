"""Removal of repeated byte strings by threshold-bounded interval expansion on a Burrows-Wheeler transform.

A byte goes where a string of ``size`` bytes that covers it also starts elsewhere in the corpus. Equal strings of ``size``
bytes choose the same anchor (the least hash of their ``gram``-byte substrings), so:

1. every text is cut into the runs of start positions that share an anchor; the bytes of such a run's strings are its context
   (anchor hash, context hash, place), found in one vectorised pass;
2. anchors found once in the corpus can't hold a repeat and go; equal contexts are one class, which enters the index once
   with its number of places as weight;
3. the distinct contexts are dealt to shards by anchor. A shard's text (contexts with separators) is suffix-sorted, and
   breadth-first backward extension of intervals on its transform derives common prefix lengths in increasing order, a level
   a length, stopping at ``size``: neighbours still unseparated then share ``size`` bytes (:func:`repeated_starts`);
4. repeated starts go back to all places of their context, are merged to spans per text, and the text's kept bytes are hashed.

An anchor with more than ``hot`` distinct contexts (the edge of a passage that very many documents quote) is not gathered:
its strings are counted by hash instead, exactly (:func:`_hot_starts`). No step compares pairs.

Defined cases: null text is empty; texts under ``size`` bytes lose nothing; overlapping occurrences in one text count;
repeated rows (also with the same doc_id) repeat each other, and each is a row of the result; a context that a text holds
several times (periodic text) is one row with its number of places, its bytes are merged where they are found; an empty
table gives an empty result; only doc_id and text are read, other columns are kept whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.columns import unused
from recollect.llm.textnum import BASE, BASE_INVERSE, give_back, mix, powers, slices, small_batches
from recollect.plans.shared import cut

SIZE, GRAM = 200, 50
SHARD_BYTES = 1 << 20
HOT_CONTEXTS = 1 << 14
LOWEST = -(1 << 63)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(data)), out=out[1:])
    return out


def substring_hashes(prefix: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    return mix((prefix[starts + lengths] - prefix[starts]) * powers(BASE_INVERSE, len(prefix))[starts] ^ (np.asarray(lengths).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)))


def least_in_window(values: np.ndarray, w: int) -> np.ndarray:
    """The least value of each window of w (minima from both sides of blocks)."""
    n = len(values)
    blocks = -(-n // w)
    padded = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    grid = padded.reshape(blocks, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


PLACE = np.uint64((1 << 20) - 1)


def contexts(data: np.ndarray, offsets: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(anchor hash, context hash, text number, first start in the text, starts) of the runs of start positions that share
    an anchor, for at most 2**20 bytes of whole texts or a part of one. Ties of the least hash go to the leftmost."""
    n = len(data)
    if n < size:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    prefix = prefix_hashes(data)
    grams = substring_hashes(prefix, np.arange(n - gram + 1), gram)
    order = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
    place = (least_in_window(order, size - gram + 1) & PLACE).astype(np.int64)
    lengths = np.diff(offsets)
    valid = np.zeros(n + 1, np.int8)
    long = lengths >= size
    valid[offsets[:-1][long]] = 1
    np.add.at(valid, (offsets[1:] - size + 1)[long], -1)
    ok = np.cumsum(valid[: n - size + 1]) > 0
    cut = ok.copy()
    cut[1:] &= (place[1:] != place[:-1]) | ~ok[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(cut)]
    cut[inner] = ok[inner]
    first = np.flatnonzero(cut)
    if not len(first):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 3
    # a run ends before the next one or where its text's starts end
    text = np.searchsorted(offsets, first, "right") - 1
    count = np.minimum(np.append(first[1:], n), offsets[1:][text] - size + 1) - first
    at = place[first]
    whole = substring_hashes(prefix, first, count - 1 + size)
    return grams[at], mix(whole ^ (at - first).astype(np.uint64)), text, first - offsets[:-1][text], count


def all_contexts(texts: pa.Array, size: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """contexts() of any batch, a slice at a time; a text over 2**20 bytes goes in parts that overlap by size - 1 bytes, so no
    start is lost."""
    step = (1 << 20) - size
    for i, _, data, offsets in slices(texts, 1 << 20):
        if len(data) <= 1 << 20:
            found = contexts(data, offsets, size, gram)
            yield (*found[:2], found[2] + i, *found[3:])
            continue
        for at in range(0, max(1, len(data) - size + 1), step):
            part = data[at : at + step + size - 1]
            found = contexts(part, np.array([0, len(part)]), size, gram)
            yield (*found[:2], found[2] + i, found[3] + at, found[4])


def once_a_text(h: np.ndarray, c: np.ndarray, text: np.ndarray, s: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """The same contexts with each text's equal ones as one row: (h, c, text, s, n, k), k places of which s is the first; and
    the merged byte ranges of the contexts with several places, as rows (0, 0, text, from, length, 0)."""
    order = np.lexsort((s, c, h, text))
    h, c, text, s, n = h[order], c[order], text[order], s[order], n[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1]) | (text[1:] != text[:-1])
    heads = np.flatnonzero(new)
    k = np.diff(np.append(heads, len(h)))
    known = np.repeat(k > 1, k)
    own, begin, end = text[known], s[known], (s + n - 1 + size)[known]
    by = np.lexsort((begin, own))
    own, begin, end = own[by], begin[by], end[by]
    # ends rise with begins, as a context's bytes go on for size - 1 bytes after its last start and runs are disjoint
    apart = np.ones(len(own), bool)
    apart[1:] = (own[1:] != own[:-1]) | (begin[1:] > end[:-1])
    first = np.flatnonzero(apart)
    last = np.append(first[1:], len(own))[: len(first)] - 1
    zero = np.zeros(len(first), np.int64)
    ranges = (zero.astype(np.uint64), zero.astype(np.uint64), own[first], begin[first], end[last] - begin[first], zero)
    return tuple(np.concatenate(x) for x in zip((h[heads], c[heads], text[heads], s[heads], n[heads], k), ranges, strict=True))


#: Symbols of a sort key (9 bits each): suffixes are told apart by them at once, and the expansion starts from them.
KEY = 7


def suffix_ranks(symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each suffix of a text of contexts, each closed by a separator (symbol 0; `ends`: its place for each position),
    and its first KEY symbols as a key. Separators are ordered by place. Prefix doubling sorts only suffixes still tied."""
    n = len(symbols)
    separators = np.flatnonzero(symbols == 0)
    place = np.arange(n, dtype=np.int32)
    key = np.zeros(n, np.int64)
    for j in range(KEY):
        at = place + j
        key <<= 9
        key |= np.where(at < ends, symbols[np.minimum(at, n - 1)], 0)
    key[separators] = -1
    order = np.argsort(key).astype(np.int32)
    ranks = np.empty(n, np.int32)
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    del ordered
    heads = np.flatnonzero(new).astype(np.int32)
    ranks[order] = heads[np.cumsum(new) - 1]
    ranks[separators] = np.arange(len(separators))
    sizes = np.diff(np.append(heads, n))
    tied = order[np.repeat(sizes > 1, sizes)]
    tied = tied[symbols[tied] != 0]
    h = KEY
    while len(tied):
        pair = (ranks[tied].astype(np.int64) << 32) | ranks[np.minimum(tied + h, ends[tied])]
        by = np.argsort(pair)
        tied, pair = tied[by], pair[by]
        old = pair >> 32
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        group = np.concatenate([[True], old[1:] != old[:-1]])
        at = np.arange(len(tied))
        ranks[tied] = old + np.maximum.accumulate(np.where(new, at, 0)) - np.maximum.accumulate(np.where(group, at, 0))
        sizes = np.diff(np.append(np.flatnonzero(new), len(tied)))
        tied = tied[np.repeat(sizes > 1, sizes)]
        h *= 2
    return ranks, key


def _first_levels(key: np.ndarray, left: np.ndarray) -> np.ndarray:
    """Common prefixes below KEY of neighbours by rank, from keys in rank order; -1: KEY or more. left: symbols before a
    suffix's separator."""
    other = key[1:] ^ key[:-1]
    equal = np.zeros(len(other), np.int16)
    for j in range(KEY):
        equal += (other >> (9 * (KEY - 1 - j))) == 0
    equal[(key[1:] < 0) | (key[:-1] < 0)] = 0
    equal = np.minimum(equal, left[1:])
    return np.where(equal < KEY, equal, -1).astype(np.int16)


def repeated_starts(bodies: list[bytes], size: int) -> np.ndarray:
    """Which positions of the joined bodies (a separator after each) start a string of `size` bytes found at another one.

    levels[k], the common prefix of the suffixes ranked k-1 and k, is derived in increasing order: at each level the intervals
    of strings of that length that were told apart one level before are extended to the left by every byte; where an
    extension's right bound has no level yet, it gets this one, and the extension is an interval of the next level. Levels
    below KEY are read off the sort keys. The loop stops at `size`; bounds without a level have longer common prefixes."""
    joined = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
    lengths = np.array([len(b) for b in bodies])
    stops = np.cumsum(lengths + 1) - 1
    ends = np.repeat(stops, lengths + 1).astype(np.int32)
    symbols = joined.astype(np.int16) + np.int16(1)
    symbols[stops] = 0
    n, m = len(symbols), len(bodies)
    ranks, key = suffix_ranks(symbols, ends)
    places = np.empty(n, np.int32)
    places[ranks] = np.arange(n, dtype=np.int32)
    left = (ends - np.arange(n, dtype=np.int32))[places]
    back = ranks[places - 1]  # LF: the rank of the suffix one to the left
    origin = np.empty(n + 1, np.int32)  # its inverse
    origin[back] = np.arange(n, dtype=np.int32)
    first = np.zeros(n + 1, np.int16)
    first[:n] = symbols[places]
    first[n] = -1
    levels = np.full(n + 1, -1, np.int16)
    levels[: m + 1], levels[n] = 0, 0
    if size > KEY:
        levels[1:n] = _first_levels(key[places], left)
        levels[: m + 1] = 0
        bounds = np.flatnonzero(levels >= 0).astype(np.int32)
        low, high = bounds[:-1], bounds[1:]
        open_ = (levels[high] == KEY - 1) & (left[low] >= KEY - 1)
        low, high, begin = low[open_], high[open_], KEY
    else:
        low, high, begin = np.array([0], np.int32), np.array([n], np.int32), 0
    del symbols, ranks, ends, joined, key, left
    for level in range(begin, size):
        widths = high - low
        if not len(widths):
            break
        k = np.arange(int(widths.sum()), dtype=np.int32) + np.repeat(low - (np.cumsum(widths) - widths).astype(np.int32), widths)
        lo, hi = np.repeat(low, widths), np.repeat(high, widths)
        q = back[k]
        c = first[q]
        real = c != 0  # strings don't cross separators
        q, lo, hi, c = q[real], lo[real], hi[real], c[real]
        is_last = (first[q + 1] != c) | (origin[q + 1] >= hi)
        is_first = (first[q - 1] != c) | (origin[q - 1] < lo)
        # the extensions of one level are disjoint ranges, so first and last ones pair up in order
        low, high = np.sort(q[is_first]), np.sort(q[is_last]) + 1
        fresh = levels[high] < 0
        low, high = low[fresh], high[fresh]
        levels[high] = level
        if level == 0:  # each separator is a string of its own, which texts may end with
            low, high = np.append(low, np.arange(m, dtype=np.int32)), np.append(high, np.arange(1, m + 1, dtype=np.int32))
    open_ = levels < 0
    hit = open_[:n] | open_[1:]
    out = np.zeros(n, bool)
    out[places[hit]] = True
    return out


def _runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], mask.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def index_shard(table: pa.Table, size: int) -> pa.Table:
    """(h, c, a, b): ranges of repeated starts in each context of a shard (h, c, k, body). Each distinct context is in the
    index once with its number of places as weight: a string is repeated if another suffix shares it or its weight is 2."""
    h, c, k = (table.column(n).to_numpy() for n in ("h", "c", "k"))
    order = np.lexsort((c, h))
    new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])])
    heads = np.flatnonzero(new)
    weights, rows = k[order][heads], order[heads]  # k counts all places, also where a repeated row has brought a context twice
    bodies = table.column("body").take(pa.array(rows)).to_pylist()
    found = repeated_starts(bodies, size)
    begins = np.cumsum([0] + [len(x) + 1 for x in bodies])
    for row in np.flatnonzero(weights > 1):
        found[begins[row] : begins[row + 1] - size] = True
    a, b = _runs(found)
    row = np.searchsorted(begins, a, "right") - 1  # a context's last start is followed by size - 1 bytes: runs don't cross
    return pa.table({"h": pa.array(h[rows][row]), "c": pa.array(c[rows][row]), "a": pa.array((a - begins[row]).astype(np.int32)), "b": pa.array((b - begins[row]).astype(np.int32))})


def _hot_starts(parts: DataFrame, size: int) -> DataFrame:
    """The same as index_shard for contexts of one anchor in any number: strings counted by two 64-bit hashes."""

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(3), 1 << 18):
                prefix = prefix_hashes(data)
                counts = np.maximum(np.diff(offsets) - size + 1, 0)
                rows = np.repeat(np.arange(j - i), counts)
                a = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = offsets[:-1][rows] + a
                one = substring_hashes(prefix, at, size)
                two = mix(substring_hashes(prefix, at, size // 2) * np.uint64(31) + substring_hashes(prefix, at + size // 2, size - size // 2))
                pick = pa.array(rows + i)
                yield pa.RecordBatch.from_arrays([*[batch.column(x).take(pick) for x in range(3)], pa.array(a.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64))], ["h", "c", "k", "a", "one", "two"])

    rows = parts.select("h", "c", "k", "body").mapInArrow(strings, "h long, c long, k long, a int, one long, two long")
    # a repeated row has brought its contexts twice, but then k is over 1 anyway
    often = rows.groupBy("one", "two").agg(F.sum("k").alias("n")).where("n > 1").select("one", "two")
    return rows.join(often, ["one", "two"]).select("h", "c", "a", (F.col("a") + 1).alias("b"))


def spans(keyed: DataFrame, i: str, t: str, size: int = SIZE, gram: int = GRAM, hot: int = HOT_CONTEXTS, shard_bytes: int = SHARD_BYTES, bound: int = 1 << 22) -> DataFrame:
    """(i, t, spans): for each distinct text (by id and hash) that has any, the byte ranges of repeated strings, not merged.

    keyed: documents with columns of the names i and t. bound: repeated anchors are sent to the tasks up to this number
    (8 bytes each), beyond it they join."""
    spark = keyed.sparkSession
    texts = keyed.select(F.col(i).alias("i"), F.col(t).alias("t"), "text")

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in all_contexts(batch.column(0), size, gram):
                h, n = np.unique(found[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    repeated = cut(texts.select("text").mapInArrow(anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h"))
    n = repeated.count()
    known = None
    if n <= bound:
        got = repeated.toArrow().column("h").to_numpy() if n else np.zeros(0, np.int64)
        known = spark.sparkContext.broadcast(np.sort(got))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for found in all_contexts(batch.column(2), size, gram):
                if known is not None:
                    table, own = known.value, found[0].view(np.int64)
                    ok = table[np.minimum(np.searchsorted(table, own), len(table) - 1)] == own if len(table) else np.zeros(len(own), bool)
                    found = tuple(x[ok] for x in found)
                h, c, text, s, count, k = once_a_text(*found, size)
                pick = pa.array(text)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), batch.column(0).take(pick), batch.column(1).take(pick), *[pa.array(x.astype(np.int32)) for x in (s, count, k)]], ["h", "c", "i", "t", "s", "n", "k"])

    found = texts.mapInArrow(places, "h long, c long, i long, t long, s int, n int, k int")
    found = cut(found if known is not None else found.where("k > 0").join(repeated, "h", "left_semi").unionByName(found.where("k = 0")))
    classes = cut(found.where("k > 0").groupBy("h", "c").agg(F.sum("k").alias("k"), F.min(F.struct("i", "t", "s", "n")).alias("at")))
    per_anchor = classes.groupBy("h").agg(F.count("*").alias("m"), F.sum(F.col("at.n") + size).alias("bytes"))
    sizes = per_anchor.agg(F.sum("bytes").alias("bytes"), F.max("m").alias("most")).head()
    shards = max(1, -(-int(sizes["bytes"] or 0) // shard_bytes))
    crowded = (sizes["most"] or 0) > hot
    if crowded:  # heavy anchors are told here, on rows of a few numbers: the contexts' bytes needn't travel for it
        heavy = cut(per_anchor.where(F.col("m") > hot).select("h").withColumn("hot", F.lit(True)))
        few = heavy.count() <= bound
        classes = classes.join(F.broadcast(heavy) if few else heavy, "h", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    else:
        classes = classes.withColumn("hot", F.lit(False))

    # each class's bytes are cut from one of its places; all columns go along, so that this join's shuffle of the documents is
    # the one that the last join uses too
    rows_at = unused(keyed.columns, "rows")[0]
    wanted = classes.groupBy(F.col("at.i").alias(i), F.col("at.t").alias(t)).agg(F.collect_list(F.struct("h", "c", "k", F.col("at.s").alias("s"), F.col("at.n").alias("n"), "hot")).alias(rows_at))
    fetched = keyed.join(wanted, [i, t]).select(*keyed.columns, rows_at)
    text_at, key_at = keyed.columns.index("text"), [keyed.columns.index(x) for x in (i, t)]

    def bodies(of_hot: bool) -> DataFrame:
        def slice_bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[tuple] = set()  # a repeated row is read once
            for batch in small_batches(batches, text_at):
                h, c, k, body = [], [], [], []
                for key, text, rows in zip(zip(*[batch.column(x).to_pylist() for x in key_at], strict=True), batch.column(text_at), batch.column(len(batch.schema.names) - 1), strict=True):
                    if key in seen:
                        continue
                    seen.add(key)
                    whole = (text.as_py() or "").encode()
                    for r in rows.as_py():
                        if r["hot"] == of_hot:
                            h.append(r["h"])
                            c.append(r["c"])
                            k.append(r["k"])
                            body.append(whole[r["s"] : r["s"] + r["n"] - 1 + size])
                yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(c, pa.int64()), pa.array(k, pa.int64()), pa.array(body, pa.binary())], ["h", "c", "k", "body"])

        own = fetched.where(F.exists(rows_at, lambda r: r["hot"] == F.lit(of_hot))) if crowded else fetched
        return own.mapInArrow(slice_bodies, "h long, c long, k long, body binary")

    def index(table: pa.Table) -> pa.Table:
        out = index_shard(table, size)
        give_back()
        return out

    dealt = bodies(False).withColumn("shard", F.pmod(F.xxhash64("h"), F.lit(shards)))
    indexed = dealt.groupBy("shard").applyInArrow(index, "h long, c long, a int, b int")
    starts = indexed.unionByName(_hot_starts(bodies(True), size)) if crowded else indexed
    covered = found.where("k > 0").select("h", "c", "i", "t", "s").join(starts, ["h", "c"]).select("i", "t", (F.col("s") + F.col("a")).alias("from"), (F.col("s") + F.col("b") - 1 + size).alias("to"))
    covered = covered.unionByName(found.where("k = 0").select("i", "t", F.col("s").alias("from"), (F.col("s") + F.col("n")).alias("to")))
    # the copies of a row have found the same ranges
    return covered.groupBy(F.col("i").alias(i), F.col("t").alias(t)).agg(F.collect_set(F.struct("from", "to")).alias("spans"))


def merged(rows: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted((r["from"], r["to"]) for r in rows):
        if out and a <= out[-1][1]:
            if b > out[-1][1]:
                out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def removed(docs: DataFrame, **options: int) -> tuple[DataFrame, list[str]]:
    """docs with five more columns, and their names: the remaining bytes, their whole characters (null for a null text), the
    numbers of bytes, removed bytes and removed runs."""
    from pyspark.sql import types as T

    i, t, *names = unused(docs.columns, "i", "t", "kept", "words", "n_bytes", "n_removed", "n_spans")
    found_at = unused([*docs.columns, i, t], "spans")[0]
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), t: F.xxhash64(F.coalesce("text", F.lit("")))})
    found = spans(keyed, i, t, **options)
    joined = keyed.join(found.withColumnRenamed(found.columns[-1], found_at), [i, t], "left").select(*docs.columns, found_at)
    text_at, last = docs.columns.index("text"), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_at):
            kept, sizes, gone, parts = [], [], [], []
            for text, rows in zip(batch.column(text_at).to_pylist(), batch.column(last).to_pylist(), strict=True):
                whole = (text or "").encode()
                ranges = merged(rows) if rows else []
                at, pieces = 0, []
                for a, b in ranges:
                    pieces.append(whole[at:a])
                    at = b
                kept.append(b"".join([*pieces, whole[at:]]))
                sizes.append(len(whole))
                gone.append(sum(b - a for a, b in ranges))
                parts.append(len(ranges))
            words = [None if x is None else k.decode(errors="ignore") for x, k in zip(batch.column(text_at).to_pylist(), kept, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(kept, pa.binary()), pa.array(words, pa.string()), *[pa.array(x, pa.int64()) for x in (sizes, gone, parts)]], [*batch.schema.names[:last], *names])

    kinds = (T.BinaryType(), T.StringType(), T.LongType(), T.LongType(), T.LongType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, kind) for c, kind in zip(names, kinds, strict=True)]])
    return joined.mapInArrow(run, schema), names


def report(docs: DataFrame, **options: int) -> DataFrame:
    out, (kept, _, *counts) = removed(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", *counts, F.sha2(kept, 256).alias("kept_sha256"))


def apply(docs: DataFrame, **options: int) -> DataFrame:
    """docs with its own columns; text without repeated bytes (bytes of characters that were cut in half go too), n_chars
    (if there) following it."""
    out, (_, words, *_) = removed(docs, **options)
    lengths = {"n_chars": F.length(words).cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns({"text": F.col(words)} | lengths).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract by counting every 200-byte string (as hexadecimal digits).
SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, md5(substr(h, CAST(2 * i + 1 AS BIGINT), 400)) AS k FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 199)) AS i FROM d WHERE length(h) >= 400)),
often AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT doc_id, i FROM s WHERE k IN (SELECT k FROM often)),
cut AS (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM hit),
run AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM cut),
span AS (SELECT doc_id, g, min(i) AS a, max(i) + 200 AS b FROM run GROUP BY doc_id, g),
gap AS (SELECT d.doc_id, coalesce(lag(span.b) OVER w, 0) AS a, span.a AS b, d.h FROM d JOIN span USING (doc_id) WINDOW w AS (PARTITION BY d.doc_id ORDER BY span.a)
  UNION ALL SELECT d.doc_id, coalesce(max(span.b), 0), length(any_value(d.h)) // 2, any_value(d.h) FROM d LEFT JOIN span USING (doc_id) GROUP BY d.doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * a + 1 AS BIGINT), CAST(2 * (b - a) AS BIGINT)), '' ORDER BY a) AS h FROM gap GROUP BY doc_id),
t AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, length(d.h) // 2 AS n_bytes, CAST(coalesce(t.n_removed, 0) AS BIGINT) AS n_removed, coalesce(t.n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN t USING (doc_id)
"""
