"""Document fingerprints by MinHash.

Each document's five-word shingles are hashed once; ``PERMUTATIONS`` universal hash functions ``(a*x + b) >> 32`` with odd
64-bit ``a`` are evaluated in numpy over whole slices of a batch, and the minimum of each per document (its 16 high-mixed
bits) is the signature. Signature bands are joined in Spark and candidates are verified by exact Jaccard
(:func:`near_duplicates`).

Defined cases: null text is the empty text; a text without words has the constant signature ``ffff...`` and is like no
other text but one without words (likeness 1); 1 to 4 words are one shingle; equal texts have equal fingerprints; repeated
rows each give a row; an empty table gives an empty result; only ``doc_id`` and ``text`` are read, whatever other columns
are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.textnum import shingles_of, slices

PERMUTATIONS = 128
SHINGLE = 5
_rng = np.random.default_rng(20240601)
A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def signatures(texts: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """uint16 array (len(texts), PERMUTATIONS)."""
    out = np.full((len(texts), PERMUTATIONS), 0xFFFF, np.uint16)
    for i, j, data, offsets in slices(texts):
        hashes, bounds = shingles_of(data, offsets, k)
        out[i:j] = minima(hashes, bounds)
    return out


def minima(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Signatures from shingle hashes; all ones where there is no shingle."""
    out = np.full((len(bounds) - 1, PERMUTATIONS), 0xFFFF, np.uint16)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        at, work = bounds[full], np.empty_like(hashes)
        for p in range(PERMUTATIONS):
            np.multiply(hashes, A[p], out=work)
            work += B[p]
            least = np.minimum.reduceat(work, at)
            # the least value is small, so its high bits carry little: the low half is as good as a hash of it
            out[full, p] = ((least >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)
    return out


def hexed(rows: np.ndarray) -> list[str]:
    text = np.ascontiguousarray(rows.astype(">u2")).tobytes().hex()
    n = rows.shape[1] * 4
    return [text[i : i + n] for i in range(0, len(text), n)]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal components; a text without words is like no text that has some."""
    same = (a == b).mean(axis=1)
    bare_a, bare_b = (a == 0xFFFF).all(axis=1), (b == 0xFFFF).all(axis=1)
    return np.where(bare_a != bare_b, 0.0, same)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_chars, fingerprint) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t or "") for t in texts.to_pylist()], pa.int64()), pa.array(hexed(signatures(texts)), pa.string())], ["doc_id", "n_chars", "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def descending_parts(docs: DataFrame, parts: int) -> tuple[DataFrame, int]:
    """docs (id, text) cut into ranges of descending id, a partition each, and sorted; the row after a range's last comes
    with it once more (`sentinel`). The cuts and each range's first id, a few numbers a range, are the driver's only share."""
    ids = docs.select("id")
    cuts = ids.agg(F.percentile_approx("id", [i / parts for i in range(1, parts)], 10000).alias("q")).head()[0] if parts > 1 else []
    cuts = sorted(set(cuts or []), reverse=True)
    part = F.lit(0)
    if cuts:
        bounds = F.array(*[F.lit(c).cast("long") for c in cuts])
        part = F.size(F.filter(bounds, lambda c: c > F.col("id"))).cast("int")
    firsts = {r["part"]: r["top"] for r in ids.groupBy(part.alias("part")).agg(F.max("id").alias("top")).collect()}
    order = sorted(firsts)
    if not order:
        return docs.select(F.lit(0).alias("part"), "id", "text", F.lit(False).alias("sentinel")).limit(0), 1
    before = {firsts[p]: order[i - 1] for i, p in enumerate(order)}
    also = F.coalesce(F.try_element_at(F.create_map(*[F.lit(v) for top, p in before.items() for v in (top, p)]), F.col("id")), F.lit(-1))
    # the wrap: the first of all follows the last, also where there is one range
    places = F.filter(F.array(F.struct(part.alias("part"), F.lit(False).alias("sentinel")), F.struct(also.alias("part"), F.lit(True).alias("sentinel"))), lambda s: s["part"] >= 0)
    spread = docs.select("id", "text", F.explode(places).alias("p")).select(F.col("p.part").alias("part"), "id", "text", F.col("p.sentinel").alias("sentinel"))
    n = max(order) + 1
    return spread.repartitionById(n, F.col("part")).sortWithinPartitions("part", "sentinel", F.col("id").desc(), F.xxhash64("text")), n


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row per row of docs: its fingerprint, that of its edited text, and the likeness of its fingerprint to the edited
    text's and the next document's. The edited text has the last floor(n_chars/3) code points replaced by as many of the
    first (or all) of the next document by descending doc_id (ties by the text's hash; null ids last; after the last: the first)."""
    spark = docs.sparkSession
    parts = parts or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    lowest = -(1 << 63)
    plain = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(lowest)).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    spread, _ = descending_parts(plain, parts)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list, str | None]]:
        """Runs of (ids, texts, the text after the last), of bounded bytes."""
        ids: list = []
        texts: list[str] = []
        held, done = 0, False
        for batch in batches:
            for i, text, sentinel in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if sentinel:
                    if not done and ids:
                        yield ids, texts, text
                    ids, texts, done = [], [], True
                    continue
                if held > 1 << 21:
                    yield ids, texts, text
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(text)
                held += len(text)
        if ids:
            yield ids, texts, None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, after in rows(batches):
            nexts = [*texts[1:], texts[0] if after is None else after]
            edited = [t[: len(t) - len(t) // 3] + n[: len(t) // 3] for t, n in zip(texts, nexts, strict=True)]
            own = signatures(pa.array([*texts, nexts[-1]], pa.large_string()))
            other = signatures(pa.array(edited, pa.large_string()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([None if i == lowest else i for i in ids], pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(hexed(own[:-1])), pa.array(hexed(other)),
                    pa.array(likeness(own[:-1], other)), pa.array(likeness(own[:-1], own[1:])),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )

    return spread.mapInArrow(run, OUT)


#: 25 bands of 5 of the components: a pair of Jaccard 0.8 shares a band with probability 0.99995.
BANDS, BAND = 25, 5


def near_duplicates(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(doc_id, class_id, n_links): signature bands joined in Spark, candidate groups verified by exact Jaccard of shingles."""
    from recollect.llm.chosen_path import linked

    return linked(docs, threshold, keys=lambda sig: band_keys(sig))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64 array (len(sig), BANDS)."""
    from recollect.llm.textnum import mix

    out = np.zeros((len(sig), BANDS), np.uint64)
    for b in range(BANDS):
        part = np.full(len(sig), b + 1, np.uint64)
        for j in range(BAND):
            part = mix(part * np.uint64(0x9E3779B97F4A7C15) + sig[:, b * BAND + j].astype(np.uint64))
        out[:, b] = part
    return out.view(np.int64)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
