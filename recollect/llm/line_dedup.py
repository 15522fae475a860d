"""Line deduplication with a sharded minimal perfect hash.

Keys of lines (stripped of ``[\\x20\\x09-\\x0D]``, A-Z lowered) of at least ``min_chars`` code points are hashed to 128 bits.
The distinct keys found in at least ``min_docs`` documents are cut into shards by hash; each shard is a minimal perfect hash
(levels of bit arrays with rank counts) over compact arrays of fingerprints, document counts and last holders. Documents
probe these arrays: lines never meet lines in a join. An index of at most ``broadcast_bytes`` (checked by its number of keys
before it is built) is sent to the executors once; a larger one stays in its shards, each sent to as many tasks as its probes
need, and the probes' hashes go there (:func:`_by_shard`).

Defined cases: null or empty text is one empty line; a document is a row, so repeated rows count and rows that share the
largest doc_id all keep the line; a null doc_id is lower than any other; an empty table gives an empty result; other
columns are kept or ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.columns import unused
from recollect.llm.textnum import mix, small_batches
from recollect.plans.shared import cut

STRIPPED = b" \t\n\x0b\x0c\r"
LOWERED = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 1 << 18
BROADCAST_BYTES = 48 << 20
#: Bytes of a key in the index: its fingerprint, count, last holder and bits.
INDEX_BYTES = 32
LOWEST = -(1 << 63)


def keys_of(line_bytes: list[bytes], min_chars: int) -> list[tuple[int, bytes]]:
    """(line number, 16-byte hash) of the lines whose key has at least min_chars code points. line_bytes: lowered lines."""
    out = []
    for n, line in enumerate(line_bytes):
        if len(line) >= min_chars:
            key = line.strip(STRIPPED)
            if len(key) >= min_chars and (key.isascii() or len(key.decode()) >= min_chars):
                out.append((n, xxhash.xxh3_128_digest(key)))
    return out


def _split(text: str | None) -> list[bytes]:
    return (text or "").encode().split(b"\n")


def _lowered(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOWERED).split(b"\n")


class PerfectHash:
    """A minimal perfect hash over distinct 128-bit keys (two uint64 arrays): at each level the keys alone in their cell get a
    bit; a key's index is the rank of its bit over all levels. Absent keys get any index; the fingerprint array tells them."""

    def __init__(self, low: np.ndarray, high: np.ndarray, gamma: float = 2.0) -> None:
        self.sizes, self.bits, self.ranks, base, level = [], [], [], 0, 0
        rest = np.arange(len(low))
        while len(rest):
            size = max(64, int(len(rest) * gamma) + 63 & ~63)
            at = self._cells(low[rest], high[rest], level, size)
            alone = np.bincount(at, minlength=size) == 1
            placed = alone[at]
            bits = np.packbits(alone, bitorder="little")
            counts = alone.reshape(-1, 64).sum(axis=1)
            self.sizes.append(size)
            self.bits.append(bits)
            self.ranks.append((base + np.concatenate([[0], np.cumsum(counts)[:-1]])).astype(np.int32))
            base += int(counts.sum())
            rest = rest[~placed]
            level += 1
            if level > 60:
                raise ValueError("keys are not distinct")

    @staticmethod
    def _cells(low: np.ndarray, high: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix(mix(low + salt) ^ (high * salt)) % np.uint64(size)).astype(np.int64)

    def index(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """int64 indexes; -1 where no level has a bit."""
        out = np.full(len(low), -1, np.int64)
        open_ = np.arange(len(low))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks, strict=True)):
            if not len(open_):
                break
            at = self._cells(low[open_], high[open_], level, size)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            at, found = at[hit], open_[hit]
            word = at >> 6
            block = bits.reshape(-1, 8).view("<u8").ravel()[word]
            below = block & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            out[found] = ranks[word] + np.bitwise_count(below)
            open_ = open_[~hit]
        return out


class Shard:
    """Arrays behind a perfect hash: fingerprint (128 bits), documents and last holder of each key."""

    def __init__(self, low: np.ndarray, high: np.ndarray, docs: np.ndarray, last: np.ndarray) -> None:
        self.hash = PerfectHash(low, high)
        at = self.hash.index(low, high)
        self.prints, self.docs, self.last = np.empty(2 * len(high), np.uint64), np.empty(len(at), np.int32), np.empty_like(last)
        self.prints[2 * at], self.prints[2 * at + 1], self.docs[at], self.last[at] = low, high, np.minimum(docs, 2**31 - 1), last

    def probe(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, last holder) for each key."""
        at = self.hash.index(low, high)
        known = at >= 0
        here = 2 * at[known]
        known[known] = (self.prints[here] == low[known]) & (self.prints[here + 1] == high[known])
        return known, np.where(known, self.last[np.maximum(at, 0)], 0) if len(self.last) else np.zeros(len(low), np.int64)

    def dump(self) -> bytes:
        parts = [np.array(self.hash.sizes, np.int64), *self.hash.bits, *self.hash.ranks, self.prints, self.docs, self.last]
        head = np.array([len(self.hash.sizes), *[p.nbytes for p in parts]], np.int64)
        return head.tobytes() + b"".join(p.tobytes() for p in parts)

    @classmethod
    def load(cls, blob: bytes) -> Shard:
        self, inner = cls.__new__(cls), PerfectHash.__new__(PerfectHash)
        levels = int(np.frombuffer(blob, np.int64, 1)[0])
        n = 1 + 2 * levels + 3
        lengths, at, parts = np.frombuffer(blob, np.int64, n, 8), 8 * (n + 1), []
        kinds = [np.int64, *[np.uint8] * levels, *[np.int32] * levels, np.uint64, np.int32, np.int64]
        for kind, length in zip(kinds, lengths, strict=True):
            parts.append(np.frombuffer(blob, kind, int(length) // np.dtype(kind).itemsize, at))
            at += int(length)
        inner.sizes, inner.bits, inner.ranks = [int(x) for x in parts[0]], parts[1 : 1 + levels], parts[1 + levels : 1 + 2 * levels]
        self.hash, self.prints, self.docs, self.last = inner, *parts[-3:]
        return self


def frequent_lines(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(low, high, docs, last): the hashes of keys in at least min_docs rows, with their count and largest doc_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            ids, hashes = [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = {h for _, h in keys_of(_lowered(text), min_chars)}
                hashes += own
                ids += [LOWEST if i is None else i] * len(own)
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(ids, pa.int64())], ["low", "high", "id"])

    lines = docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(run, "low long, high long, id long")
    return lines.groupBy("low", "high").agg(F.count("*").alias("docs"), F.max("id").alias("last")).where(F.col("docs") >= min_docs)


def build_index(frequent: DataFrame, shards: int) -> DataFrame:
    """(shard, blob) by the low hash."""

    def build(key: tuple, table: pa.Table) -> pa.Table:
        col = lambda n, kind: table.column(n).to_numpy().astype(kind)
        shard = Shard(*[col(n, np.int64).view(np.uint64) for n in ("low", "high")], col("docs", np.int64), col("last", np.int64))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "blob": pa.array([shard.dump()], pa.binary())})

    return frequent.withColumn("shard", shard_of(F.col("low"), shards)).groupBy("shard").applyInArrow(build, "shard int, blob binary")


def shard_of(low, shards: int):  # noqa: ANN001, ANN201
    return F.pmod(F.shiftright(low, 33), F.lit(shards)).cast("int")


def deduplicated(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> tuple[DataFrame, list[str]]:
    """docs with three more columns, and their names: text without dropped lines (null texts stay null), the number of lines
    and of dropped lines."""
    spark = docs.sparkSession
    names = unused(docs.columns, "kept", "n_lines", "n_dropped")
    frequent = cut(frequent_lines(docs, min_chars, min_docs))
    n = frequent.count()
    shards = max(1, -(-n // SHARD_KEYS))
    index = build_index(frequent, shards)
    if n * INDEX_BYTES > broadcast_bytes:
        return _by_shard(docs, index, shards, min_chars, names), names
    blobs = {r["shard"]: bytes(r["blob"]) for r in index.collect()}
    return _by_broadcast(docs, spark.sparkContext.broadcast(blobs), shards, min_chars, names), names


def _with_result(docs: DataFrame, mapper, names: list[str]) -> DataFrame:  # noqa: ANN001
    """docs' columns plus the result's, by a mapper that gets and returns batches with docs' columns first."""
    from pyspark.sql import types as T

    kinds = (T.StringType(), T.LongType(), T.LongType())
    return docs.mapInArrow(mapper, T.StructType([*docs.schema.fields, *[T.StructField(c, kind) for c, kind in zip(names, kinds, strict=True)]]))


def _without(text: str | None, gone: set[int] | None) -> str | None:
    return b"\n".join(x for n, x in enumerate(_split(text)) if n not in gone).decode() if gone else text


def _by_broadcast(docs: DataFrame, shared, shards: int, min_chars: int, names: list[str]) -> DataFrame:  # noqa: ANN001
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = {k: Shard.load(v) for k, v in shared.value.items()}
        for batch in small_batches(batches, text_at):
            texts, ids = batch.column(text_at).to_pylist(), batch.column(id_at).to_pylist()
            where, hashes, n_lines = [], [], []
            for row, text in enumerate(texts):
                lines = _lowered(text)
                n_lines.append(len(lines))
                for number, h in keys_of(lines, min_chars):
                    where.append((row, number))
                    hashes.append(h)
            both = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
            gone: dict[int, set[int]] = {}
            if len(both) and loaded:
                shard = (both[:, 0].view(np.int64) >> 33) % shards
                for k in np.unique(shard):
                    if int(k) in loaded:
                        at = np.flatnonzero(shard == k)
                        known, last = loaded[int(k)].probe(both[at, 0], both[at, 1])
                        for i, holder in zip(at[known], last[known], strict=True):
                            row, number = where[i]
                            if (LOWEST if ids[row] is None else ids[row]) != holder:
                                gone.setdefault(row, set()).add(number)
            kept = [_without(text, gone.get(row)) for row, text in enumerate(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(kept, pa.string()), pa.array(n_lines, pa.int64()), pa.array([len(gone.get(r, ())) for r in range(len(texts))], pa.int64())], [*batch.schema.names, *names])

    return _with_result(docs, run, names)


#: Probes of a shard that go to one task together (24 bytes each).
PROBES = 1 << 20


def _by_shard(docs: DataFrame, index: DataFrame, shards: int, min_chars: int, names: list[str]) -> DataFrame:
    """The same for an index of any size. Distinct (line key, whether its last holder asks) probes go to their shards, each
    shard's arrays to as many tasks as its probes fill, and the keys to drop come back to the rows that hold them. A row is
    named by its doc_id and two hashes of its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    i, t, u, gone_at = unused(docs.columns, "i", "t", "u", "gone")
    keyed = docs.withColumns({i: F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)), t: F.xxhash64(text), u: F.xxhash64(text, F.length(text), F.lit(1))})

    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 3):
            rows, hashes, numbers = [], [], []
            for row, one in enumerate(batch.column(3).to_pylist()):
                for number, h in keys_of(_lowered(one), min_chars):
                    rows.append(row)
                    numbers.append(number)
                    hashes.append(h)
            both = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
            pick = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k).take(pick) for k in range(3)], pa.array(numbers, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["i", "t", "u", "number", "low", "high"])

    def hits(left: pa.Table, right: pa.Table) -> pa.Table:
        out = left.select(["i", "t", "u", "number"]).slice(0, 0)
        if len(right) and len(left):
            known, last = Shard.load(right.column("blob")[0].as_py()).probe(*[left.column(c).to_numpy().view(np.uint64) for c in ("low", "high")])
            out = left.select(["i", "t", "u", "number"]).filter(pa.array(known & (last != left.column("i").to_numpy())))
        return out

    asked = keyed.select(F.col(i).alias("i"), F.col(t).alias("t"), F.col(u).alias("u"), "text").mapInArrow(probes, "i long, t long, u long, number int, low long, high long")
    asked = asked.distinct().withColumn("shard", shard_of(F.col("low"), shards))
    salts = asked.groupBy("shard").agg(F.ceil(F.count("*") / PROBES).cast("int").alias("salts"))
    arrays = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("shard", "salt", "blob")
    # shards are few (a quarter of a million keys each), so this side is a small part of the keys' size
    dealt = asked.join(salts, "shard").withColumn("salt", F.pmod(F.xxhash64("i", "t", "number"), F.col("salts")).cast("int")).drop("salts")
    found = dealt.groupBy("shard", "salt").cogroup(arrays.groupBy("shard", "salt")).applyInArrow(hits, "i long, t long, u long, number int")
    gone = found.groupBy(F.col("i").alias(i), F.col("t").alias(t), F.col("u").alias(u)).agg(F.collect_set("number").alias(gone_at))
    joined = keyed.join(gone, [i, t, u], "left").select(*docs.columns, gone_at)
    text_at, last = docs.columns.index("text"), len(docs.columns)

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, text_at):
            texts, numbers = batch.column(text_at).to_pylist(), [set(x or ()) for x in batch.column(last).to_pylist()]
            kept = [_without(one, n) for one, n in zip(texts, numbers, strict=True)]
            counts = [(one or "").count("\n") + 1 for one in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns[:last], pa.array(kept, pa.string()), pa.array(counts, pa.int64()), pa.array([len(n) for n in numbers], pa.int64())], [*batch.schema.names[:last], *names])

    from pyspark.sql import types as T

    kinds = (T.StringType(), T.LongType(), T.LongType())
    return joined.mapInArrow(drop, T.StructType([*docs.schema.fields, *[T.StructField(c, kind) for c, kind in zip(names, kinds, strict=True)]]))


def report(docs: DataFrame, **options: int) -> DataFrame:
    out, (kept, *counts) = deduplicated(docs.select("doc_id", "text"), **options)
    return out.select("doc_id", *counts, F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))


def apply(docs: DataFrame, **options: int) -> DataFrame:
    """docs with its own columns; text without the dropped lines, n_chars (if there) following it."""
    out, (kept, *_) = deduplicated(docs, **options)
    lengths = {"n_chars": F.length(kept).cast("long")} if "n_chars" in docs.columns else {}
    return out.withColumns({"text": F.col(kept)} | lengths).select(docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = """
WITH raw AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM raw),
keyed AS (SELECT doc_id, n, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (SELECT k.doc_id, k.n, k.line, c.key IS NOT NULL AND k.doc_id <> c.last AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
