"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of pieces with log scores.

Text gets a marker for each blank and one in front; the best path over all pieces maximises the sum of scores, earlier
starts winning ties. Characters that no piece covers become byte pieces. A piece has markers at its front only, so the best
path of a text is the best paths of its marker-led chunks one after another; distinct chunks of a slice are solved together,
a byte position at a time in numpy, and kept in a bounded cache. A chunk over ``LONG_CHUNK`` bytes (text without blanks)
walks the trie from all its places at once, then follows the found pieces in order: linear in its length.

Scores are log probabilities. A Unigram file states them. A file of merges states ranks instead, of which sums mean nothing:
their log probabilities follow Zipf's law over the ranks, log p(r) = -log(1 + r) - log H, a rule without any training.

Decoding joins pieces, turns markers to blanks, byte pieces to bytes, and drops the front marker. A marker character in the
text itself is encoded as its bytes, so it comes back as it was and the round trip is exact.

Defined cases: null or empty text has no pieces; a text of any length is encoded whole; equal scores go to the path whose last
piece starts first; repeated rows are encoded each; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.textnum import small_batches

MARKER = "▁"
# Piece types of the model format.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
CACHE_CHUNKS = 1 << 18
LONG_CHUNK, WINDOW = 512, 1 << 16
# Kinds of model in a file's trainer part.
UNIGRAM, MERGES = 1, 2
SLICE_CHARS = 1 << 20


def _fields(data: bytes) -> Iterator[tuple[int, int, bytes | int]]:
    """(number, wire type, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, kind, varint()
        else:
            n = varint() if kind == 2 else {5: 4, 1: 8}[kind]
            yield tag >> 3, kind, data[at : at + n]
            at += n


def zipf_scores(ranks: list[float]) -> list[float]:
    """Log probabilities from merge ranks (0 or falling: the files state them negated)."""
    total = math.log(math.fsum(1 / (1 - r) for r in ranks))
    return [-math.log(1 - r) - total for r in ranks]


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, log score, type) in the order of ids, from a model file."""
    with open(path, "rb") as f:  # installed on every machine like a library; it is no input
        data = f.read()
    out, model = [], UNIGRAM
    for number, _, value in _fields(data):
        if number == 2:
            model = next((v for n, _, v in _fields(value) if n == 3), UNIGRAM)
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, _, v in _fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            out.append((piece, score, kind))
    if model == MERGES:
        real = [k for k, (_, _, kind) in enumerate(out) if kind == NORMAL]
        for k, score in zip(real, zipf_scores([out[k][1] for k in real]), strict=True):
            out[k] = (out[k][0], score, out[k][2])
    return out


@dataclass
class Trie:
    """Double array: the child of state s by byte c is base[s] + c + 1 where check[that] == s; value: piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> Trie:
        words = sorted(keys)
        size = 4 * sum(map(len, words)) + 1024
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        used, cursor, last = bytearray(size), 1, 0
        used[0] = 1
        todo = [(0, 0, len(words), 0)]  # state, range of words, depth
        while todo:
            state, a, b, depth = todo.pop()
            if len(words[a]) == depth:
                value[state] = keys[words[a]]
                a += 1
            if a == b:
                continue
            cuts: list[tuple[int, int, int]] = []
            i = a
            while i < b:
                c, j = words[i][depth], i + 1
                while j < b and words[j][depth] == c:
                    j += 1
                cuts.append((c, i, j))
                i = j
            # the lowest free slot of the first child where all others' are free too
            lead, rest = cuts[0][0], [c - cuts[0][0] for c, _, _ in cuts[1:]]
            at = used.find(0, max(cursor, lead + 2))
            while any(used[at + c] for c in rest):
                at = used.find(0, at + 1)
            base[state] = at - lead - 1
            for c, i, j in cuts:
                child = at - lead + c
                used[child] = 1
                last, check[child] = max(last, child), state
                todo.append((child, i, j, depth + 1))
            cursor = used.find(0, cursor)
        end = last + 258
        return cls(base[:end].copy(), check[:end].copy(), value[:end].copy())


class Pieces:
    """A piece table with its trie; encode() and decode() are exact inverses on any text."""

    def __init__(self, table: list[tuple[str, float, int]]) -> None:
        live = {p: i for i, (p, _, k) in enumerate(table) if k in (NORMAL, USER_DEFINED)}
        if any(MARKER in p.lstrip(MARKER) for p in live):
            raise ValueError("a piece with a marker inside: chunks can't be solved apart")
        self.scores = np.array([s for _, s, _ in table], np.float64)
        self.unknown = min(s for _, s, k in table if k == NORMAL) - UNKNOWN_PENALTY
        self.bytes = np.zeros(256, np.int32)
        self.surface: list[bytes] = []
        for i, (p, _, k) in enumerate(table):
            if k == BYTE:
                self.bytes[int(p[3:5], 16)] = i
                self.surface.append(bytes([int(p[3:5], 16)]))
            else:
                self.surface.append(b"" if k in (CONTROL, UNKNOWN) else p.replace(MARKER, " ").encode())
        self.is_byte = np.array([k == BYTE for _, _, k in table])
        self.trie = Trie.build({p.encode(): i for p, i in live.items()})
        self.longest = max(len(p.encode()) for p in live)
        alphabet = {c for p in live for c in p}
        # a line feed outside the alphabet stands alone on every path
        self.pattern = re.compile(r"\n| +[^ \n]*|[^ \n]+" if "\n" not in alphabet else r" +[^ ]*|[^ ]+")
        self.cache: dict[str, bytes] = {}

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def solve(self, chunks: list[str]) -> list[bytes]:
        """Ids (little-endian uint32) of each chunk (blanks stand for markers)."""
        out: list[bytes] = [b""] * len(chunks)
        # a literal marker must not meet the trie: it becomes a byte that UTF-8 never has, and is coded as its own bytes
        bodies = [c.replace(MARKER, "\0￿\0").replace(" ", MARKER).encode().replace(b"\0\xef\xbf\xbf\0", b"\xff\x96\x81") if MARKER in c else c.replace(" ", MARKER).encode() for c in chunks]
        order = sorted(range(len(chunks)), key=lambda i: len(bodies[i]))
        while order and len(bodies[order[-1]]) > LONG_CHUNK:
            out[order[-1]] = self._solve_long(bodies[order[-1]])
            order.pop()
        a = 0
        while a < len(order):
            most = max(16, 2 * len(bodies[order[a]]))
            b = a
            while b < len(order) and len(bodies[order[b]]) <= most and (b - a) * most < 1 << 21:
                b += 1
            b = max(b, a + 1)
            for i, ids in zip(order[a:b], self._solve([bodies[i] for i in order[a:b]]), strict=True):
                out[i] = ids
            a = b
        return out

    def _solve(self, bodies: list[bytes]) -> list[bytes]:
        n, lengths = len(bodies), np.array([len(b) for b in bodies])
        width = int(lengths.max(initial=0))
        text = np.zeros((n, width + 1), np.uint8)
        flat = np.frombuffer(b"".join(bodies), np.uint8)
        rows = np.repeat(np.arange(n), lengths)
        text[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
        first = (text & 0xC0) != 0x80
        step = np.where(text < 0x80, 1, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, np.where(text < 0xF8, 4, 3))))
        best = np.full((n, width + 1), -np.inf)
        best[:, 0] = 0
        start, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        for p in range(width):
            rows = np.flatnonzero((p < lengths) & first[:, p] & (best[:, p] > -np.inf))
            if not len(rows):
                continue
            before, char = best[rows, p], step[rows, p]
            alone = np.zeros(len(rows), bool)
            at, state, q = np.arange(len(rows)), np.zeros(len(rows), np.int64), p
            while len(at) and q < width:
                below = base[state] + text[rows[at], q].astype(np.int64) + 1
                ok = (check[below] == state) & (q < lengths[rows[at]])
                at, state = at[ok], below[ok]
                q += 1
                found = value[state]
                hit = found >= 0
                if hit.any():
                    k, own = at[hit], found[hit]
                    alone[k] |= char[k] == q - p
                    score, r = before[k] + self.scores[own], rows[k]
                    up = score > best[r, q]
                    r = r[up]
                    best[r, q], start[r, q], piece[r, q] = score[up], p, own[up]
            k = np.flatnonzero(~alone)
            r, end = rows[k], np.minimum(p + char[k], lengths[rows[k]])
            score = before[k] + self.unknown
            up = score > best[r, end]
            r, end = r[up], end[up]
            best[r, end], start[r, end], piece[r, end] = score[up], p, -1
        return self._ids(text, lengths, start, piece)

    def _edges(self, text: np.ndarray, low: int, high: int) -> tuple[list[int], list[int], list[float], list[int]]:
        """Pieces that start in text[low:high], as (start, end, score, id), by start; unknown characters have the id -1."""
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        first = low + np.flatnonzero((text[low:high] & 0xC0) != 0x80)
        lead = text[first]
        step = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, np.where(lead < 0xF8, 4, 3))))
        alone = np.zeros(len(first), bool)
        starts, ends, ids = [], [], []
        at, state, q = np.arange(len(first)), np.zeros(len(first), np.int64), 0
        while len(at):
            inside = first[at] + q < len(text)
            at, state = at[inside], state[inside]
            below = base[state] + text[first[at] + q].astype(np.int64) + 1
            ok = check[below] == state
            at, state, q = at[ok], below[ok], q + 1
            found = value[state]
            hit = found >= 0
            alone[at[hit]] |= step[at[hit]] == q
            starts.append(first[at[hit]])
            ends.append(first[at[hit]] + q)
            ids.append(found[hit])
        bare = np.flatnonzero(~alone)
        starts.append(first[bare])
        ends.append(np.minimum(first[bare] + step[bare], len(text)))
        ids.append(np.full(len(bare), -1, np.int32))
        s, e, i = (np.concatenate(x) for x in (starts, ends, ids))
        order = np.argsort(s, kind="stable")
        s, e, i = s[order], e[order], i[order]
        return s.tolist(), e.tolist(), np.where(i < 0, self.unknown, self.scores[i]).tolist(), i.tolist()

    def _solve_long(self, body: bytes) -> bytes:
        """One long chunk, a window of starts at a time."""
        text = np.frombuffer(body, np.uint8)
        n, reach = len(text), self.longest + 4
        start, piece = np.zeros(n + 1, np.int32), np.full(n + 1, -1, np.int32)
        best = [0.0]
        for low in range(0, n, WINDOW):
            high = min(n, low + WINDOW)
            size = min(n, high + reach) - low + 1
            best += [-math.inf] * (size - len(best))
            begin, own = start[low : low + size].tolist(), piece[low : low + size].tolist()
            for s, e, score, i in zip(*self._edges(text, low, high), strict=True):
                up = best[s - low] + score
                if up > best[e - low]:
                    best[e - low], begin[e - low], own[e - low] = up, s, i
            start[low : low + size], piece[low : low + size] = begin, own
            best = best[high - low :]
        out, at = [], n
        while at:
            s, i = int(start[at]), int(piece[at])
            out += [i] if i >= 0 else [int(self.bytes[0xE2 if b == 0xFF else b]) for b in body[s:at][::-1]]
            at = s
        return np.array(out[::-1], "<u4").tobytes()

    def _ids(self, text: np.ndarray, lengths: np.ndarray, start: np.ndarray, piece: np.ndarray) -> list[bytes]:
        """Walk the best paths back, all chunks at once; an unknown character gives its bytes."""
        steps = []
        rows, at = np.flatnonzero(lengths), lengths[lengths > 0].astype(np.int64)
        while len(rows):
            own, begin = piece[rows, at], start[rows, at].astype(np.int64)
            steps.append((rows, own, begin, np.where(own < 0, at - begin, 1)))
            rows, at = rows[begin > 0], begin[begin > 0]
        total = np.zeros(len(lengths), np.int64)
        for rows, _, _, wide in steps:
            total[rows] += wide
        ends = np.cumsum(total)
        out, at = np.zeros(int(total.sum()), "<u4"), ends.copy()
        for rows, own, begin, wide in steps:
            at[rows] -= wide
            known = own >= 0
            out[at[rows[known]]] = own[known]
            for j in range(4):
                r = np.flatnonzero(~known & (wide > j))
                b = text[rows[r], begin[r] + j]
                out[at[rows[r]] + j] = self.bytes[np.where(b == 0xFF, 0xE2, b)]
        raw, begins = out.tobytes(), ends - total
        return [raw[4 * a : 4 * b] for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32 bytes."""
        chunked = [self.pattern.findall(" " + t) if t else [] for t in texts]
        new = list(set().union(*chunked) - self.cache.keys()) if chunked else []
        fresh = dict(zip(new, self.solve(new), strict=True))
        if len(self.cache) + len(fresh) <= CACHE_CHUNKS:
            self.cache.update(fresh)
            table = self.cache
            return [b"".join([table[c] for c in chunks]) for chunks in chunked]
        known = self.cache
        return [b"".join([known[c] if c in known else fresh[c] for c in chunks]) for chunks in chunked]

    def decode(self, ids: bytes) -> str:
        surface = self.surface
        whole = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode(errors="replace")
        return whole[1:] if whole[:1] == " " else whole


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the piece ids of each row's text."""
    return _mapped(docs, path, "doc_id long, ids array<int>", lambda table, ids, texts, coded: [ids, pa.array([np.frombuffer(x, "<i4") for x in coded], pa.list_(pa.int32()))])


def decoded(rows: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    shared = rows.sparkSession.sparkContext.broadcast(Pieces(read_pieces(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [shared.value.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def _mapped(docs: DataFrame, path: str, schema: str, columns) -> DataFrame:  # noqa: ANN001
    shared = docs.sparkSession.sparkContext.broadcast(Pieces(read_pieces(path)))
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in small_batches(batches, 1, SLICE_CHARS):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(columns(table, batch.column(0), texts, table.encode(texts)), names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def report(docs: DataFrame, path: str) -> DataFrame:
    """Each row encoded and decoded again: number of pieces, byte pieces, a checksum of the ids, the decoded text's digest."""

    def columns(table: Pieces, ids: pa.Array, texts: list[str], coded: list[bytes]) -> list[pa.Array]:
        back = [table.decode(x) for x in coded]
        by_bytes = [int(table.is_byte[np.frombuffer(x, "<u4")].sum()) for x in coded]
        return [
            ids, pa.array([len(x) // 4 for x in coded], pa.int64()), pa.array(by_bytes, pa.int64()), pa.array([zlib.crc32(x) for x in coded], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([a == b for a, b in zip(texts, back, strict=True)]),
        ]

    return _mapped(docs, path, "doc_id long, n_pieces long, n_byte_pieces long, ids_crc32 long, decoded_sha256 string, round_trip boolean", columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("piece_bpe_32k.model"))
