"""Set-similarity join of documents by chosen paths.

A document is its set of five-word shingles; two documents are linked at Jaccard >= 0.8. Per run, sets are split on sampled
shared tokens: a node's children are the values of signature components drawn by the node's hash, so a pair of similarity j
goes on together with probability j a level, wherever it is evaluated. Nodes start at depth ``DEPTH``; a bucket of more than
``small`` sets is split further on sampled tokens, down to ``deepest``. Runs are repeated until a pair at the threshold is
found together with probability ``RECALL``.

Small buckets are compared by brute force on signatures (sets that are surely not similar are let go), which leaves groups
of candidate sets: a group's sets are fetched once, dealt to blocks of bounded size, and every pair of blocks is verified by
exact set intersections. Only class links and counts leave a block, never pairs.

Equal shingle sets are one class from the start: a class of a thousand copies is one set. Groups of any size are split into
blocks, so no task gathers an unbounded group.

Defined cases: null text is empty; a text without words is linked to none; 1 to 4 words are one shingle; rows that share a
doc_id are rows of one class member each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.columns import sieved, unused
from recollect.llm.components import components
from recollect.llm.minhash import PERMUTATIONS, minima
from recollect.llm.textnum import mix, shingles_of, slices
from recollect.plans.shared import cut

THRESHOLD = 0.8
DEPTH, RECALL = 3, 0.99999
RUNS = math.ceil(math.log(1 - RECALL) / math.log(1 - THRESHOLD**DEPTH))
SMALL, DEEPEST = 128, 7
#: Ways in which a crowded bucket is split at each level: with two tokens a way, a pair at the threshold that every run's
#: bucket crowds is still found with RECALL (see recall_of).
WAYS = (4, 2)
BLOCK = 256
#: Sets of a crowded bucket that its others are compared with, and sets a block where those in no group are compared with all.
PIVOTS, STRAYS = 8, (1024, 4096)
#: Least share of equal signature components at which two sets of a bucket stay candidates: five standard deviations under 0.8.
SURE = 0.8 - 5 * math.sqrt(0.8 * 0.2 / PERMUTATIONS)
LOWEST = -(1 << 63)


def child(nodes: np.ndarray, sig: np.ndarray, way: int = 0) -> np.ndarray:
    """The node below, on the token drawn by the node: a component of the signature (sig: a row per node)."""
    drawn = mix(nodes + np.uint64(0x632BE59BD9B4E019 * (way + 1) % (1 << 64)))
    column = (drawn % np.uint64(sig.shape[1])).astype(np.int64)
    return mix(drawn ^ (sig[np.arange(len(sig)), column].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def recall_of(ways: tuple[int, ...], runs: int = RUNS, j: float = THRESHOLD) -> float:
    """The probability that a pair which shares j of its components meets in some run though all its buckets are crowded."""
    kept = 1.0
    for n in reversed(ways):
        kept = 1 - (1 - j * j * kept) ** n
    return 1 - (1 - j**DEPTH * kept) ** runs


def path_keys(sig: np.ndarray, runs: int = RUNS, depth: int = DEPTH) -> np.ndarray:
    """int64 (len(sig), runs): each run's node at `depth`."""
    out = np.empty((len(sig), runs), np.uint64)
    for r in range(runs):
        node = np.full(len(sig), mix(np.array([r + 1], np.uint64))[0])
        for _ in range(depth):
            node = child(node, sig)
        out[:, r] = node
    return out.view(np.int64)


def set_keys(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles, their bounds, and a 64-bit hash of each document's set."""
    counts = np.diff(bounds)
    doc = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    hashes, doc = hashes[new], doc[new]
    bounds = np.searchsorted(doc, np.arange(len(counts) + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ np.uint64(0x2545F4914F6CDD1D)), dtype=np.uint64)])
    return hashes, bounds, mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _profiles(docs: DataFrame, keys: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(i, t, s1, n, sig, keys) for each row of docs (i, t, text); s1: the set's hash, n: its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(2)):
                hashes, bounds = shingles_of(data, offsets)
                hashes, bounds, s1 = set_keys(hashes, bounds)
                sig = minima(hashes, bounds)
                own = keys(sig)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, own.shape[1], dtype=np.int32)), pa.array(own.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(s1), pa.array(np.diff(bounds).astype(np.int64)), pa.array([row.tobytes() for row in sig], pa.binary()), lists], ["i", "t", "s1", "n", "sig", "keys"])

    return docs.mapInArrow(run, "i long, t long, s1 long, n long, sig binary, keys array<long>")


def streamed_groups(batches: Iterator[pa.RecordBatch], key: int = 1) -> Iterator[pa.Table]:
    """Tables of consecutive rows with equal first `key` columns, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        table = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(key)]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in table], axis=0)) + 1
        cuts = [0, *change.tolist(), len(batch)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            now = tuple(c[a] for c in table)
            if last is not None and now != last:
                yield pa.Table.from_batches(held)
                held = []
            last = now
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index of each index's component, by minimum labels and jumping."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], least)
        np.minimum.at(new, label[b], least)
        new = new[new]
        if (new == label).all():
            break
        label = new
    while True:
        new = label[label]
        if (new == label).all():
            return label
        label = new


def _bucket_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each set to the least one of its likely group in a bucket. Batches: (node, id, sig) sorted by node; buckets
    of a bounded number of sets, many of which are compared at once."""
    held: list[pa.RecordBatch] = []
    size, last = 0, None
    for batch in batches:
        if not len(batch):
            continue
        node = batch.column(0).to_numpy()
        if size >= 1 << 13 and node[0] != last:
            yield _compared(held)
            held, size = [], 0
        head = int(np.searchsorted(node, node[-1])) if size + len(batch) >= 1 << 13 else 0
        if head:  # all but the last bucket, which may go on
            yield _compared([*held, batch.slice(0, head)])
            held, size, batch = [], 0, batch.slice(head)
        held.append(batch)
        size, last = size + len(batch), node[-1]
    if held:
        yield _compared(held)


def _compared(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """(a, b) for whole buckets."""
    node, ids = (np.concatenate([x.column(c).to_numpy() for x in held]) for c in (0, 1))
    sig = np.frombuffer(b"".join(v for x in held for v in x.column(2).to_pylist()), np.uint16).reshape(len(ids), -1)
    at = np.arange(len(ids))
    ends = np.append(np.flatnonzero(node[1:] != node[:-1]) + 1, len(ids))
    left = ends[np.searchsorted(ends, at, "right")] - at - 1  # sets after this one in its bucket
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = 1 + (1 << 15) // max(1, int(left.max(initial=0)))
    for low in range(0, len(ids), step):
        x = np.repeat(at[low : low + step], left[low : low + step])
        first = np.repeat(np.cumsum(left[low : low + step]) - left[low : low + step], left[low : low + step])
        y = x + 1 + np.arange(len(x)) - first
        same = (sig[x] == sig[y]).mean(axis=1) >= SURE
        a.append(x[same]), b.append(y[same])
    root = roots(len(ids), np.concatenate(a), np.concatenate(b))
    moved = ids[root] != ids
    links = np.unique(np.stack([ids[moved], ids[root[moved]]], axis=1), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(links[:, 0]), pa.array(links[:, 1])], ["a", "b"])


def crowded(nodes: DataFrame, small: int) -> DataFrame:
    """(node, id, m) of the buckets of m > 1 sets. Of those that are compared at once (up to `small` sets) one of each
    content, as runs find the same groups again and again; larger ones are each run's own trial and all stay."""
    rows = cut(nodes.join(nodes.groupBy("node").agg(F.count("*").alias("m")).where("m > 1"), "node"))
    little = rows.where(F.col("m") <= small)
    contents = little.groupBy("node", "m").agg(F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("content"))
    once = contents.groupBy("m", "content").agg(F.min("node").alias("node")).select("node")
    return little.join(once, "node", "left_semi").unionByName(rows.where(F.col("m") > small))


def settled(large: DataFrame, sigs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a, b) links of crowded buckets that are one group, and the rows (node, id) of the others. Each set of a bucket is
    compared with ``PIVOTS`` drawn ones; sets likely similar to one, and pivots that have such a set in common, are one
    candidate group. If it holds half of the bucket or more, its sets are linked by their least, and the others are compared
    with every set of the bucket, in blocks of STRAYS, so no pair is lost. Splitting such a bucket would find its group
    again and again, on more rows at each level."""
    if not large.limit(1).count():
        return large.select(F.col("id").alias("a"), F.col("id").alias("b")), large
    drawn = large.groupBy("node").agg(F.array(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id"))["id"] for k in range(PIVOTS)]).alias("p"))
    pivots = drawn.select("node", F.posexplode("p").alias("k", "id")).join(sigs, "id").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "sig"))).alias("p"))
    pivots = pivots.select("node", F.transform("p", lambda x: x["sig"]).alias("others"))
    rows = large.join(sigs, "id").select("node", "id", "sig").join(pivots, "node")
    bits = sum((F.when(F.col("alike")[k], 1 << k).otherwise(0) for k in range(PIVOTS)), F.lit(0))
    flagged = cut(rows.select("node", "id", "sig", "others").mapInArrow(_alike, "node long, id long, alike array<boolean>").select("node", "id", bits.alias("mask")))
    # at most 2**PIVOTS masks a bucket: the pivots that hang together with the most frequent mask's
    masks = flagged.groupBy("node", "mask").agg(F.count("*").alias("n"), F.min("id").alias("least")).groupBy("node").agg(F.sum("n").alias("m"), F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("minus"), "mask", "least"))).alias("of"))
    first = F.filter("of", lambda x: x["mask"] != 0)[0]["mask"]
    united = masks.withColumn("all", F.aggregate(F.flatten(F.array_repeat("of", PIVOTS)), first, lambda u, x: F.when(u.bitwiseAND(x["mask"]) != 0, u.bitwiseOR(x["mask"])).otherwise(u)))
    inside = F.filter("of", lambda x: x["mask"].bitwiseAND(F.col("all")) != 0)
    chosen = united.select("node", "all", F.array_min(F.transform(inside, lambda x: x["least"])).alias("root"), "m", (F.col("m") + F.aggregate(inside, F.lit(0).cast("long"), lambda t, x: t + x["minus"])).alias("u"))
    blocks = lambda c, n: F.ceil(F.col(c) / n).cast("int")
    chosen = chosen.select("node", "all", "root", (2 * F.col("u") <= F.col("m")).alias("one"), "u", blocks("u", STRAYS[0]).alias("xs"), blocks("m", STRAYS[1]).alias("ys"))
    told = cut(flagged.join(chosen, "node").select("node", "id", "root", "one", "u", "xs", "ys", (F.col("mask").bitwiseAND(F.col("all")) != 0).alias("near")))
    links = told.where("one and near and id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    body = told.where("one and u > 0").join(sigs, "id")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    place = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    own = [F.col(c).alias(c) for c in ("node", "id", "sig")]
    left = body.where("not near").select(*own, place("xs").alias("x"), every("ys").alias("y")).alias("l").groupBy("node", "x", "y")
    right = body.select(F.col("node").alias("node"), F.col("id").alias("own"), F.when(F.col("near"), F.col("root")).otherwise(F.col("id")).alias("id"), F.col("sig").alias("sig"), every("xs").alias("x"), place("ys").alias("y")).alias("r").groupBy("node", "x", "y")
    return links.unionByName(left.cogroup(right).applyInArrow(_strays, "a long, b long")), told.where("not one").select("node", "id")


def _strays(left: pa.Table, right: pa.Table) -> pa.Table:
    """(a, b) links of sets (node, id, sig) that are in no group to what is alike in a bucket (node, own, id, sig); own: the set
    itself, id: its group's least."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(left) and len(right):
        one, two = (np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint16).reshape(len(t), -1) for t in (left, right))
        own, ids = right.column("own").to_numpy(), right.column("id").to_numpy()
        for z, sig in zip(left.column("id").to_numpy(), one, strict=True):
            met = np.unique(ids[((two == sig).mean(axis=1) >= SURE) & (own != z)])
            a.append(np.full(len(met), z)), b.append(met)
    a, b = np.concatenate(a), np.concatenate(b)
    names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    root = names[roots(len(names), at[: len(a)], at[len(a) :])]
    moved = root != names
    return pa.table({"a": pa.array(names[moved], pa.int64()), "b": pa.array(root[moved], pa.int64())})


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, id, alike): whether the row's signature is likely similar to each of the others it comes with."""
    for batch in batches:
        sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(batch), -1) if len(batch) else np.zeros((0, PERMUTATIONS), np.uint16)
        lists = batch.column(3)
        other = np.frombuffer(b"".join(lists.flatten().to_pylist()), np.uint16).reshape(-1, sig.shape[1])
        lengths = lists.value_lengths().to_numpy()
        own, same = np.repeat(np.arange(len(sig)), lengths), np.empty(len(other), bool)
        for k in range(0, len(own), 1 << 13):
            same[k : k + (1 << 13)] = (sig[own[k : k + (1 << 13)]] == other[k : k + (1 << 13)]).mean(axis=1) >= SURE
        alike = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(same))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), alike], ["node", "id", "alike"])


def candidate_links(nodes: DataFrame, sigs: DataFrame, small: int = SMALL, depth: int = DEPTH, deepest: int = DEEPEST) -> DataFrame:
    """(a, b) links of candidates, from (node, id) and (id, sig): buckets over `small` that aren't one group (settled) are
    split on further sampled tokens first. At the last level a bucket still larger isn't gathered: its sets are linked by its least id. Only the signatures
    of sets in shared buckets are read again."""
    found, level = [], 0
    while True:
        sized = cut(crowded(nodes, small))
        if not level:
            sigs = cut(sigs.join(sized.select("id").distinct(), "id", "left_semi"))
        little, large = sized.where(F.col("m") <= small).select("node", "id"), sized.where(F.col("m") > small).select("node", "id")
        if depth < deepest:
            near, large = settled(large, sigs)
            found.append(near)
        found.append(little.join(sigs, "id").select("node", "id", "sig").repartition("node").sortWithinPartitions("node", "id").mapInArrow(_bucket_links, "a long, b long"))
        if depth >= deepest:
            least = large.groupBy("node").agg(F.min("id").alias("least"))
            found.append(large.join(least, "node").where("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")))
        if depth >= deepest or not large.limit(1).count():
            break

        def split(batches: Iterator[pa.RecordBatch], ways: int = WAYS[min(level, len(WAYS) - 1)]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                node = batch.column(0).to_numpy().view(np.uint64)
                sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16).reshape(len(node), -1) if len(node) else np.zeros((0, PERMUTATIONS), np.uint16)
                for way in range(ways):
                    below = child(child(node, sig, way), sig)
                    yield pa.RecordBatch.from_arrays([pa.array(below.view(np.int64)), batch.column(1)], ["node", "id"])

        # two more tokens a level, in WAYS, as a pair at the threshold is lost on a token in a fifth of cases; every run's
        # bucket is split by itself, so the runs stay independent trials
        nodes = cut(large.join(sigs, "id").select("node", "id", "sig").mapInArrow(split, "node long, id long"))
        depth, level = depth + 2, level + 1
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return _stars(out)


def _stars(links: DataFrame) -> DataFrame:
    """Links (a, b), b < a, that connect the same sets: each set goes to the least one it is linked to, as do the others it is
    linked to. A set has no more links than runs times ways; those between the few least ones fall together."""
    own = links.groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("to"))
    pairs = F.array_append(F.transform("to", lambda b: F.struct(b.alias("a"), F.col("least").alias("b"))), F.struct("a", F.col("least").alias("b")))
    return own.select(F.explode(pairs).alias("e")).select("e.a", "e.b").where("a <> b").distinct()


def verified(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Per pair of blocks (group, x, y; then id, block, copies, shingles): each set's links (weighted by copies) and root."""
    limit = Fraction(threshold).limit_denominator(1000)
    p, q = limit.numerator, limit.denominator  # j >= p/q  <=>  (p + q) * both >= p * (|a| + |b|)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in streamed_groups(batches, 3):
            ids, block, copies = (group.column(c).to_numpy() for c in ("id", "block", "copies"))
            x, y = int(group.column("x")[0].as_py()), int(group.column("y")[0].as_py())
            rows = np.arange(len(ids))
            one, two = (rows, rows) if x == y else (rows[block == x], rows[block == y])
            if len(ids) < 2 or not len(one) or not len(two):
                continue
            bodies = [np.frombuffer(s, np.uint64) for s in group.column("shingles").to_pylist()]
            sizes = np.array([len(s) for s in bodies])
            linked = (p + q) * intersections(bodies, one, two) >= p * (sizes[one][:, None] + sizes[two][None, :])
            links = np.zeros(len(ids), np.int64)
            if x == y:
                np.fill_diagonal(linked, False)
            else:
                links[two] = linked.T @ copies[one]
            links[one] += linked @ copies[two]
            a, b = np.nonzero(linked)
            root = roots(len(ids), one[a], two[b])
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, root, ids)
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(links), pa.array(least[root])], ["id", "links", "root"])

    return run


def intersections(bodies: list[np.ndarray], one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sorted sets, rows `one` by rows `two`, by products of incidence blocks over the elements
    that both sides hold (one side: that are held twice)."""
    own = len(one) == len(bodies)
    side = np.zeros(len(bodies), bool)
    side[two] = not own
    place = np.empty(len(bodies), np.int64)
    place[two], place[one] = np.arange(len(two)), np.arange(len(one))
    values, owner = np.concatenate(bodies), np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
    order = np.argsort(values)
    values, owner = values[order], owner[order]
    heads = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    counts = np.diff(np.append(heads, len(values)))
    second = np.add.reduceat(side[owner].astype(np.int64), heads)
    shared = (counts > 1) if own else (second > 0) & (second < counts)
    number, owner = np.repeat(np.cumsum(shared) - 1, counts), owner[np.repeat(shared, counts)]
    number = number[np.repeat(shared, counts)]
    out = np.zeros((len(one), len(two)), np.int64)
    if not len(number):
        return out
    width = int(min(max(64, (1 << 21) // len(bodies)), number[-1] + 1))
    cuts = np.searchsorted(number, np.arange(0, number[-1] + width + 1, width))
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            matrix = np.zeros((1 if own else 2, max(len(one), len(two)), width), np.float32)
            matrix[side[owner[a:b]].astype(np.int64), place[owner[a:b]], number[a:b] - k * width] = 1
            out += np.rint(matrix[0, : len(one)] @ (matrix[0, : len(one)] if own else matrix[1, : len(two)]).T).astype(np.int64)
    return out


def linked(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:  # noqa: ANN003
    """(doc_id, class_id, n_links) for each row: the least doc_id of its class of linked documents, and how many other rows
    it is linked to."""
    real = lambda c: F.when(F.col(c) != LOWEST, F.col(c))
    return classes(docs, threshold, **options).select(real("i").alias("doc_id"), real("class_id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:  # noqa: ANN003
    """docs with its own columns, one row of each class: that of the least doc_id (then text hash)."""
    i, t = unused(docs.columns, "i", "t")
    chosen = classes(docs, threshold, **options).groupBy("label").agg(F.min(F.struct("i", "t")).alias("c")).select(F.col("c.i").alias(i), F.col("c.t").alias(t))
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), t: F.xxhash64(F.coalesce("text", F.lit("")))})
    return keyed.join(chosen, [i, t], "left_semi").dropDuplicates([i, t]).select(docs.columns)


def classes(docs: DataFrame, threshold: float = THRESHOLD, keys: Callable[[np.ndarray], np.ndarray] = path_keys, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """(i, t, label, class_id, n_links) for each row: i its doc_id (null: the lowest long), t its text's hash."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("i"), F.xxhash64(text).alias("t"), text.alias("text"))
    profiles = cut(_profiles(keyed, keys))
    members = profiles.select("i", "t", "s1", "n")
    sigs = cut(profiles.where("n > 0").groupBy(F.col("s1").alias("id")).agg(F.first("sig").alias("sig"), F.first("keys").alias("keys")))
    nodes = sigs.select(F.explode("keys").alias("node"), "id")
    links = candidate_links(nodes, sigs.select("id", "sig"), small)
    groups = cut(components(links).withColumnRenamed("node", "set").withColumnRenamed("label", "grp"))

    # a row to read each candidate set from, and its number of copies
    sets = members.where("n > 0").groupBy(F.col("s1").alias("set")).agg(F.min(F.struct("i", "t")).alias("at"), F.count("*").alias("copies"))
    counts = groups.groupBy("grp").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    wide = groups.join(counts, "grp").join(sets, "set").select("set", "at.i", "at.t", "grp", "copies", "blocks", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int").alias("block"))
    return _verify(keyed, members, cut(wide), threshold)


def _verify(keyed: DataFrame, members: DataFrame, wide: DataFrame, threshold: float) -> DataFrame:
    """wide: (set, i, t, grp, copies, blocks, block): candidate sets and a row to read each from. Only the texts of these
    rows are shuffled."""
    last = len(wide.columns)

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, offsets in slices(batch.column(last)):
                hashes, bounds, s1 = set_keys(*shingles_of(data, offsets))
                raw = hashes.tobytes()
                right = np.flatnonzero(s1 == batch.column(0).to_numpy()[i:j])
                bodies = pa.array([raw[8 * bounds[k] : 8 * bounds[k + 1]] for k in right], pa.binary())
                pick = pa.array(right + i)
                yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)).take(pick) for c in kept], bodies], [*kept, "shingles"])

    names, kept = wide.columns, ["set", "grp", "copies", "blocks", "block"]
    near = sieved(keyed, F.xxhash64("i", "t"), wide, F.xxhash64("i", "t")).dropDuplicates(["i", "t"])
    texts = wide.join(near, ["i", "t"]).select(*names, "text")
    sets = texts.mapInArrow(fetch, "set long, grp long, copies long, blocks int, block int, shingles binary")
    dealt = sets.select("grp", "set", "block", "copies", "shingles", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    pairs = dealt.select("grp", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), F.col("set").alias("id"), "block", "copies", "shingles")
    results = cut(pairs.repartition("grp", "x", "y").sortWithinPartitions("grp", "x", "y", "id").mapInArrow(verified(threshold), "id long, links long, root long"))
    own = results.groupBy("id").agg(F.sum("links").alias("links"))
    classes = components(results.select(F.col("id").alias("a"), F.col("root").alias("b")))
    per_set = members.where("n > 0").groupBy("s1").agg(F.min("i").alias("least"), F.count("*").alias("copies"))
    labelled = per_set.join(own, F.col("s1") == F.col("id"), "left").join(classes, F.col("s1") == F.col("node"), "left")
    labelled = labelled.select("s1", "least", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "s1").alias("label"))
    names_of = labelled.groupBy("label").agg(F.min("least").alias("class_id"))
    table = labelled.join(names_of, "label").select(F.col("s1").alias("k"), "label", "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = members.join(table, (F.col("s1") == F.col("k")) & (F.col("n") > 0), "left")
    return out.select("i", "t", F.coalesce("label", F.xxhash64("i", "t")).alias("label"), F.coalesce("class_id", "i").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
cut AS (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM cut),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 9 * shared >= 4 * (x.n + y.n)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT DISTINCT a AS doc_id, a AS other FROM e UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS class_id FROM r GROUP BY doc_id), k AS (SELECT a AS doc_id, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(k.n_links, 0) AS n_links FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
