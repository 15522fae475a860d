"""Packing by power-of-two decomposition.

A document's tokens (and one closing id 0) are cut into pieces of the sequence length and of falling powers of two below it;
each piece is a sequence of its own in the bucket of its length, so no sequence crosses documents and none is padded. The
operator is one map: nothing is shuffled.

Token ids are those of the ``tokenizers`` file named by the caller; the merges run in ``tiktoken`` on the same vocabulary
(several times faster) behind a bounded cache of blank-delimited chunks, which the tests hold against ``tokenizers``.

Defined cases: null text is empty (one piece: the closing id); special tokens' strings are ordinary text; repeated rows are
packed each; an empty table gives no piece; other columns are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from recollect.llm.textnum import small_batches

LENGTH = 1024
END = 0
CACHE_CHUNKS = 1 << 17
_CHUNK = re.compile(r"[ \n]*[^ \n]+|[ \n]+$")
_OTHER_SPACE = re.compile(r"[^\S \n]|[\x1c-\x1f\x85]")
_encoders: dict[str, Encoder] = {}


class Encoder:
    """Ids of a byte-level BPE file, as little-endian uint32 bytes."""

    def __init__(self, path: str) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:  # a tokenizer file is installed on every machine; it is no input
            spec = json.load(f)
        special = {t["content"] for t in spec["added_tokens"]}
        # the byte alphabet of byte-level BPE: printable bytes stand for themselves, the others for code points from 256
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in shown} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in shown)}
        ranks = {bytes(back[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
        import public_tokenizers

        self._bpe = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._cache: dict[str, bytes] = {}

    def _new(self, chunk: str) -> bytes:
        ids = np.array(self._bpe.encode_ordinary(chunk), "<u4").tobytes()
        if len(self._cache) < CACHE_CHUNKS and len(chunk) < 64:
            self._cache[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if _OTHER_SPACE.search(text):  # runs of mixed blanks aren't cut at a blank
            return np.array(self._bpe.encode_ordinary(text), "<u4").tobytes()
        get, new = self._cache.get, self._new
        return b"".join([get(c) or new(c) for c in _CHUNK.findall(text)])


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(n: int, most: int = LENGTH) -> list[tuple[int, int]]:
    """(start, length): whole sequences, then falling powers of two."""
    out = [(s, most) for s in range(0, n - n % most, most)]
    start, rest, size = n - n % most, n % most, most
    while rest:
        size //= 2
        if rest >= size:
            out.append((start, size))
            start, rest = start + size, rest - size
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, bucket int"


def packed(docs: DataFrame, path: str, most: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """A row per piece (= sequence). bucket: the binary logarithm of its length. with_ids: the ids too."""
    if most & (most - 1):
        raise ValueError("the sequence length must be a power of two")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        # unique without a shuffle: the partition in the high bits, the piece's number in it in the low ones
        number = TaskContext.get().partitionId() << 40
        for batch in small_batches(batches, 1):
            rows: list[tuple] = []
            bodies: list[bytes] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = own.ids(text or "") + END.to_bytes(4, "little")
                view, n = memoryview(ids), len(ids) // 4
                for start, length in pieces(n, most):
                    body = view[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(body), n, number, 0, length.bit_length() - 1))
                    number += 1
                    if with_ids:
                        bodies.append(bytes(body))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            arrays = [pa.array(c, pa.int64() if k < 7 else pa.int32()) for k, c in enumerate(columns)]
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            if with_ids:
                flat = pa.array(np.frombuffer(b"".join(bodies), "<u4").astype(np.int32))
                cuts = pa.array(np.concatenate([[0], np.cumsum([len(b) // 4 for b in bodies])]).astype(np.int32))
                arrays.append(pa.ListArray.from_arrays(cuts, flat))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path())
