"""Language-model scoring by a log-bilinear neural model trained with noise-contrastive estimation in numpy.

Tokens are lower-cased (A-Z) words and one end per text. The model predicts an output unit from the two before it: the up to
``TOP`` most frequent tokens are units of their own, all others share ``CLASSES`` units by their first letters, and inside a
shared unit a token has its smoothed share of the unit's training count, so every token, also an unseen one, has a normalised
probability. Units of like frequency form clusters of ``MEMBERS``: a unit's probability is its cluster's times its own in the
cluster, each normalised by batched matrix products, so a large vocabulary costs two small products a token. A context's
vector is the sum of its units' vectors under position weights; a score is its product with an output vector plus a bias.

1. Training counts of all tokens are gathered by hash (one shuffle of partial counts, a row per distinct token and task).
2. Training texts become unit ids, equal ones of a task are one row with their number, and go to shards of about
   ``SHARD_TOKENS`` tokens by hash; a shard is trained in a fixed order from the common start against ``NOISE`` shared noise
   units a batch, copies as one text of that weight, and each parameter row is averaged over the shards by how often it was
   used. All training texts count, and the result depends on the texts only, not on how they lie in partitions (but for the
   last bits of sums).
3. Texts are dealt to groups of bounded bytes; a group's distinct rarer tokens fetch their counts by a join (frequent ones are
   units, whose counts go along with the model), and each group is scored. No vocabulary is broadcast but the units.

Defined cases: null text is empty (one token: the end); a null doc_id counts as the empty text in the hold-out rule;
repeated rows are scored each; an empty training share leaves uniform units; an empty table gives an empty result; only
doc_id and text are read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from recollect.llm.textnum import LOWER, mix, slices, span_hashes, word_spans
from recollect.plans.shared import cut

TOP, CLASSES, MEMBERS, WIDTH = 8192, 64, 128, 24
NOISE, BATCH, RATE = 64, 4096, 0.05
SHARD_TOKENS = 1 << 22
ROWS = 1024
GROUP_BYTES = 6 << 20
END = np.uint64(0x1)
SMOOTH = 0.1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes (END after each text), their letter classes, and bounds per text."""
    data = LOWER[data]
    starts, ends, bounds = word_spans(data, offsets)
    texts = len(offsets) - 1
    out, kinds = np.full(len(starts) + texts, END, np.uint64), np.zeros(len(starts) + texts, np.int64)
    at = np.arange(len(starts)) + np.repeat(np.arange(texts), np.diff(bounds))
    hashes = span_hashes(data, starts, ends)
    hashes[hashes == END] += np.uint64(1)
    out[at] = hashes
    if len(starts):
        second = np.where(ends - starts > 1, data[np.minimum(starts + 1, len(data) - 1)], 0)
        letters = data[starts].astype(np.uint64) << np.uint64(8) | second.astype(np.uint64)
        kinds[at] = (mix(letters + np.uint64(1)) % np.uint64(CLASSES)).astype(np.int64)
    return out, kinds, bounds + np.arange(texts + 1)


class Units:
    """Which unit a token belongs to, the units' training totals, their clusters. top: hashes by falling count (the end is a
    frequent token like others); shared units follow. As an input, unit `size` stands before the text."""

    def __init__(self, top: np.ndarray, counts: np.ndarray, rare: dict[int, tuple[int, int]]) -> None:
        self.top = len(top)
        self.size = self.top + CLASSES
        self.order = np.argsort(top)
        self.sorted = top[self.order]
        self.totals, self.kinds = np.zeros(self.size), np.zeros(CLASSES)
        self.totals[: self.top] = counts
        for k, (total, kinds) in rare.items():
            self.totals[self.top + k], self.kinds[k] = total, kinds
        self.total = float(self.totals.sum())
        whole = -(-self.top // MEMBERS)
        self.cluster = np.concatenate([np.arange(self.top) // MEMBERS, whole + np.arange(CLASSES)])  # a shared unit is alone
        self.clusters = whole + CLASSES

    def of(self, hashes: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        if not self.top:
            return kinds
        at = np.minimum(np.searchsorted(self.sorted, hashes), self.top - 1)
        return np.where(self.sorted[at] == hashes, self.order[at], kinds + self.top)

    def shares(self) -> np.ndarray:
        """Smoothed unigram distribution of units: the start of the biases and the noise."""
        return (self.totals + 1.0) / (self.total + self.size)

    def cluster_shares(self) -> np.ndarray:
        return np.bincount(self.cluster, weights=self.shares(), minlength=self.clusters)

    def inside(self, units: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Natural log of each token's share of its unit (0 for a unit of its own); unseen tokens have a count of 0."""
        kind = np.maximum(units - self.top, 0)
        share = (counts + SMOOTH) / (self.totals[kind + self.top] + SMOOTH * (self.kinds[kind] + 1))
        return np.where(units < self.top, 0.0, np.log(share))


class Model:
    TABLES = ("inputs", "outputs", "groups", "positions")

    def __init__(self, units: Units, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda n: rng.normal(0, 0.1, (n, WIDTH + 1)).astype(np.float32)
        # each table's last column is its rows' bias (unused in inputs and positions)
        self.units, self.inputs, self.outputs, self.groups = units, draw(units.size + 1), draw(units.size), draw(units.clusters)
        self.positions = np.ones((2, WIDTH + 1), np.float32)
        self.outputs[:, -1], self.groups[:, -1] = np.log(units.shares()), np.log(units.cluster_shares())

    def vectors(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Context vectors; their last column is 1, so that a product with an output row takes in its bias."""
        out = np.take(self.inputs, first, axis=0)
        out *= self.positions[0]
        other = np.take(self.inputs, second, axis=0)
        other *= self.positions[1]
        out += other
        out[:, -1] = 1
        return out

    @staticmethod
    def normalised(vectors: np.ndarray, table: np.ndarray, picks: np.ndarray) -> np.ndarray:
        """Log-softmax over a table's rows at the picked one, for each vector; in blocks that stay in a core's cache."""
        out, turned, ones = np.empty(len(vectors)), np.ascontiguousarray(table.T), np.ones(len(table), np.float32)
        for a in range(0, len(vectors), ROWS):
            v = vectors[a : a + ROWS]
            scores = v @ turned
            if not -40 < scores.min() <= scores.max() < 40:  # only then could the sum overflow or vanish
                scores -= scores.max(axis=1)[:, None]
            own = scores[np.arange(len(scores)), picks[a : a + ROWS]]
            out[a : a + ROWS] = own - np.log(np.exp(scores, out=scores) @ ones)
        return out

    def log_probabilities(self, first: np.ndarray, second: np.ndarray, units: np.ndarray) -> np.ndarray:
        """Normalised natural log probabilities of units after contexts (first, second: the last and the one before it)."""
        vectors, cluster = self.vectors(first, second), self.units.cluster[units]
        out = self.normalised(vectors, self.groups, cluster)
        order = np.argsort(cluster, kind="stable")
        cuts = np.searchsorted(cluster[order], np.arange(-(-self.units.top // MEMBERS) + 1))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            if a < b:
                at, low = order[a:b], k * MEMBERS
                out[at] += self.normalised(vectors[at], self.outputs[low : min(low + MEMBERS, self.units.top)], units[at] - low)
        return out


class Trainer:
    """Stochastic ascent of the noise-contrastive objective with per-parameter step sizes, of units and of clusters."""

    def __init__(self, model: Model, seed: int) -> None:
        self.model, self.rng, self.seen = model, np.random.default_rng(seed), 0
        shares = {"outputs": model.units.shares(), "groups": model.units.cluster_shares()}
        self.noise = {n: (np.cumsum(p), np.log(NOISE * p).astype(np.float32)) for n, p in shares.items()}
        self.squares = {n: np.full(getattr(model, n).shape, 1e-2, np.float32) for n in Model.TABLES}
        self.used = {n: np.zeros(len(getattr(model, n)), np.int64) for n in Model.TABLES}

    def _step(self, name: str, rows: np.ndarray, slopes: np.ndarray) -> None:
        """Ascend on rows (repeats are summed first)."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # sorted by radix; rows are under 2**16
        ordered = rows[order]
        heads = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        total, at = np.add.reduceat(np.take(slopes, order, axis=0), heads, axis=0), ordered[heads]
        table, squares = getattr(self.model, name), np.take(self.squares[name], at, axis=0)
        squares += total * total
        self.squares[name][at] = squares
        total *= np.float32(RATE)
        total /= np.sqrt(squares, out=squares)
        total += np.take(table, at, axis=0)
        table[at] = total
        self.used[name][at] += np.diff(np.append(heads, len(rows)))

    def _contrast(self, name: str, v: np.ndarray, targets: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """A step on one output table; the slope at the context vectors."""
        table, (cumulative, log_noise) = getattr(self.model, name), self.noise[name]
        noise = np.minimum(np.searchsorted(cumulative, self.rng.random(NOISE) * cumulative[-1]), len(table) - 1)
        out, other = np.take(table, targets, axis=0), np.take(table, noise, axis=0)
        real = np.einsum("ij,ij->i", v, out) - log_noise[targets]
        up = weights / (1 + np.exp(np.clip(real, -30, 30)))
        against = -other.T
        against[-1] += log_noise[noise]
        odds = v @ against
        with np.errstate(over="ignore"):  # an infinite value gives a slope of 0
            np.exp(odds, out=odds)
        odds += 1
        down = np.divide(-weights[:, None], odds, out=odds)
        steps, n = np.empty((len(v) + NOISE, WIDTH + 1), np.float32), len(v)
        np.multiply(up[:, None], v, out=steps[:n])
        np.matmul(down.T, v, out=steps[n:])
        out *= up[:, None]
        out += down @ other
        self._step(name, np.concatenate([targets, noise]), steps)
        return out

    def learn(self, first: np.ndarray, second: np.ndarray, units: np.ndarray, weights: np.ndarray | None = None) -> None:
        m = self.model
        weights = np.ones(len(units), np.float32) if weights is None else weights.astype(np.float32)
        for a in range(0, len(units), BATCH):
            f, s, u = first[a : a + BATCH], second[a : a + BATCH], units[a : a + BATCH]
            v = m.vectors(f, s)
            w = weights[a : a + BATCH]
            slope = self._contrast("outputs", v, u, w)
            slope += self._contrast("groups", v, m.units.cluster[u], w)
            slope[:, -1] = 0  # biases are no part of a context
            inputs = np.empty((2 * len(u), WIDTH + 1), np.float32)
            for k in (0, 1):
                np.multiply(slope, m.positions[k], out=inputs[k * len(u) : (k + 1) * len(u)])
            positions = np.stack([np.einsum("ij,ij->j", slope, np.take(m.inputs, x, axis=0)) for x in (f, s)]) / len(u)
            self._step("inputs", np.concatenate([f, s]), inputs)
            self._step("positions", np.arange(2), positions.astype(np.float32))
            self.seen += len(u)


def contexts_of(units: np.ndarray, bounds: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
    """The unit before each token and the one before that; `before` before a text."""
    first, second = np.full(len(units), before), np.full(len(units), before)
    first[1:], second[2:] = units[:-1], units[:-2]
    heads = bounds[:-1]
    first[heads], second[heads] = before, before
    after = heads[np.diff(bounds) > 1] + 1
    second[after] = before
    return first, second


def keyed(docs: DataFrame) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10 == 0
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), held.alias("held_out"))


def token_counts(train: DataFrame) -> DataFrame:
    """(h, kind, c) of the training texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def fold() -> tuple[np.ndarray, ...]:
            h, k, c = (np.concatenate(x) for x in zip(*held, strict=True))
            u, at, back = np.unique(h, return_index=True, return_inverse=True)
            return u, k[at], np.bincount(back, weights=c).astype(np.int64)

        def batch_of(x: tuple[np.ndarray, ...]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["h", "kind", "c"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, k, _ = tokens(data, offsets)
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, k[at], c))
                size += len(u)
            if size > 1 << 21:
                held = [fold()]
                size = len(held[0][0])
                if size > 1 << 20:
                    yield batch_of(held[0])
                    held, size = [], 0
        if held:
            yield batch_of(fold())

    return train.select("text").mapInArrow(run, "h long, kind int, c long").groupBy("h").agg(F.first("kind").alias("kind"), F.sum("c").alias("c"))


def trained(train: DataFrame, units: Units, tokens_in_all: int) -> Model:
    """The mean of the models of all shards."""
    shared = train.sparkSession.sparkContext.broadcast(units)
    kind = "<u2"  # units are under 2**16

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()
        size = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["ids", "copies"])

        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                h, k, bounds = tokens(data, offsets)
                raw = shared.value.of(h, k).astype(kind).tobytes()
                held.update(raw[2 * a : 2 * b] for a, b in zip(bounds, bounds[1:], strict=False))
                size += len(raw)
                if size > 1 << 24:
                    yield batch_of()
                    held, size = Counter(), 0
        yield batch_of()

    def learn(table: pa.Table) -> pa.Table:
        own = shared.value
        trainer = Trainer(Model(own), 11)
        copies: Counter[bytes] = Counter()
        for body, n in zip(table.column("ids").to_pylist(), table.column("copies").to_pylist(), strict=True):
            copies[body] += n
        bodies, held, size = sorted(copies), [], 0
        for n, body in enumerate(bodies):
            held.append(body)
            size += len(body)
            if size > 1 << 19 or n == len(bodies) - 1:
                u, lengths = np.frombuffer(b"".join(held), kind).astype(np.int64), [len(x) // 2 for x in held]
                trainer.learn(*contexts_of(u, np.cumsum([0, *lengths]), own.size), u, np.repeat([copies[x] for x in held], lengths))
                held, size = [], 0
        parts = []
        for t, name in enumerate(Model.TABLES):
            at = np.flatnonzero(trainer.used[name])
            values = getattr(trainer.model, name)[at].astype(np.float64)
            parts.append(pa.table({"t": pa.array(np.full(len(at), t, np.int32)), "row": pa.array(at.astype(np.int32)), "n": pa.array(trainer.used[name][at]), **{f"v{j}": pa.array(values[:, j]) for j in range(WIDTH + 1)}}))
        return pa.concat_tables(parts)

    # a text that many rows share comes once a task, and a shard learns it once
    shards = max(1, -(-tokens_in_all // SHARD_TOKENS))
    dealt = train.select("text").mapInArrow(coded, "ids binary, copies long").withColumn("shard", F.pmod(F.xxhash64("ids"), F.lit(shards)).cast("int"))
    columns = [f"v{j}" for j in range(WIDTH + 1)]
    parts = dealt.groupBy("shard").applyInArrow(learn, "t int, row int, n long, " + ", ".join(f"{c} double" for c in columns))
    mean = parts.groupBy("t", "row").agg(*[(F.sum(F.col(c) * F.col("n")) / F.sum("n")).alias(c) for c in columns])
    got = mean.toArrow()  # a row per parameter row: bounded by TOP, whatever the corpus
    model = Model(units)
    for t, name in enumerate(Model.TABLES):
        own = got.filter(pa.array(got.column("t").to_numpy() == t)) if len(got) else got
        if len(own):
            getattr(model, name)[own.column("row").to_numpy()] = np.column_stack([own.column(c).to_numpy() for c in columns]).astype(np.float32)
    return model


def most_frequent(counts: DataFrame) -> list[Row]:
    """The TOP rows of (h, kind, c) by falling count, ties by h. A histogram over eighths of powers of two (some 500 rows at
    most) tells a count that at least TOP tokens reach, so the tasks send the driver few rows more than TOP between them."""
    step = F.floor(F.log2("c") * 8)
    held, least = 0, 0
    for r in sorted(counts.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
        held, least = held + r["count"], r["s"]
        if held >= TOP:
            break
    return counts.where(step >= least).orderBy(F.desc("c"), "h").limit(TOP).collect()


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(docs: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per row of docs, in SCORES' columns; learns from the rows that are not held out."""
    spark = docs.sparkSession
    rows = keyed(docs)
    train = rows.where(~F.col("held_out"))
    counts = cut(token_counts(train))
    top = most_frequent(counts)
    totals = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).head()
    least = (top[-1]["c"], top[-1]["h"]) if top else (0, 0)
    rare = counts.where((F.col("c") < least[0]) | ((F.col("c") == least[0]) & (F.col("h") > least[1]))) if len(top) == TOP else counts.limit(0)
    kinds = {r["kind"]: (int(r["n"]), int(r["v"])) for r in rare.groupBy("kind").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect()}
    units = Units(np.array([r["h"] for r in top], np.int64).view(np.uint64), np.array([r["c"] for r in top], float), kinds)
    n, v = int(totals["n"] or 0), int(totals["v"])
    model = trained(train, units, n)
    shared = spark.sparkContext.broadcast(model)

    size = rows.agg(F.sum(F.octet_length("text") + 64)).head()[0] or 0
    groups = max(1, -(-int(size) // group_bytes))
    # the row's number keeps copies of one row apart; which group scores a row changes nothing
    dealt = rows.withColumn("g", F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        found = [np.unique(tokens(data, offsets)[0]) for _, _, data, offsets in slices(table.column("text"))]
        h = np.setdiff1d(np.unique(np.concatenate(found)), shared.value.units.sorted, assume_unique=True)
        return pa.table({"g": pa.array([key[0].as_py()] * len(h), pa.int32()), "h": pa.array(h.view(np.int64))})

    asked = dealt.groupBy("g").applyInArrow(distinct, "g int, h long")
    answers = asked.join(counts.select("h", "c"), "h").select("g", "h", "c")

    def score(texts: pa.Table, table: pa.Table) -> pa.Table:
        net = shared.value
        own = net.units
        h_known = table.column("h").to_numpy().view(np.uint64)
        order = np.argsort(h_known)
        h_known, c_known = h_known[order], table.column("c").to_numpy()[order]
        out: list[tuple[np.ndarray, ...]] = []
        for _, _, data, offsets in slices(texts.column("text")):
            h, k, bounds = tokens(data, offsets)
            c = np.zeros(len(h), np.int64)
            if len(h_known):
                at = np.minimum(np.searchsorted(h_known, h), len(h_known) - 1)
                c = np.where(h_known[at] == h, c_known[at], 0)
            u = own.of(h, k)
            c = np.where(u < own.top, own.totals[u].astype(np.int64), c)
            base = np.log10((c + SMOOTH) / (n + SMOOTH * (v + 1)))
            logs = (net.log_probabilities(*contexts_of(u, bounds, own.size), u) + own.inside(u, c)) / np.log(10)
            sums = lambda x: np.add.reduceat(x, bounds[:-1])
            out.append((np.diff(bounds), sums((c > 0).astype(np.int64)), sums(base), sums(logs)))
        lengths, hits, base, logs = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0))
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": texts.column("held_out"), "n_tokens": pa.array(lengths), "n_known": pa.array(hits), "train_tokens": pa.array([n] * len(texts), pa.int64()), "base_score": pa.array(base), "score": pa.array(logs)})

    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(score, SCORES)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark.read.parquet(f"{sf_dir}/documents.parquet"))
