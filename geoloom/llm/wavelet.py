"""Token-ID output: a wavelet matrix per shard, one compressed file (a row of binary) with everything in it.

A shard's ids are stored bit by bit from the highest: each plane holds one bit of every id in the order that sorting
by the planes above has left, packed into 64-bit words, and with it the number of ones before each block of 512. So
rank is a count of a block's ones and select a search among counts, both on the packed words: an id is read, an id's
occurrences are counted and the k-th is found in as many steps as an id has bits. `find` does so over all shards. A
whole range is read by undoing the planes from the lowest up.

Edge cases: null text is empty; an empty document is its end id alone; a shard holds whole documents, one at least,
so a very long document has a shard to itself; rows with equal doc_id are ordered by text; a null doc_id comes first;
an empty table gives no shard; extra columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, small_batches, stored, typed
from .tokens import encoder, with_end

MAGIC = b"WVM2"
#: Bits and words of a block, before which the ones are counted.
BLOCK, WORDS = 512, 8
SHARD_TOKENS = 1 << 18


class WaveletMatrix:
    """Ids below 2**bits. planes: (words, counts) of each bit, the highest first; counts: ones before each block."""

    def __init__(self, n: int, planes: list[tuple[np.ndarray, np.ndarray]]):
        self.n, self.planes = n, planes

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now, planes = np.asarray(ids).astype(cls._type(bits)), []
        size = (len(now) // BLOCK + 1) * BLOCK // 8
        for k in range(bits - 1, -1, -1):
            one = now & now.dtype.type(1 << k) != 0
            packed = np.zeros(size, np.uint8)
            packed[: (len(now) + 7) // 8] = np.packbits(one, bitorder="little")
            words = packed.view("<u8")
            sums = np.bitwise_count(words).reshape(-1, WORDS).sum(1, dtype=np.uint32)
            planes.append((words, np.concatenate([[0], np.cumsum(sums, dtype=np.uint32)]).astype("<u4")))
            now = np.concatenate([now[np.flatnonzero(~one)], now[np.flatnonzero(one)]])
        return cls(len(now), planes)

    @staticmethod
    def _type(bits: int):
        return np.uint16 if bits <= 16 else np.uint32

    def _zeros(self, k: int) -> int:
        return self.n - int(self.planes[k][1][-1])

    def _ones(self, k: int, at: np.ndarray) -> np.ndarray:
        """Ones of a plane before each place."""
        words, counts = self.planes[k]
        block, word = at // BLOCK, at // 64
        out = counts[block].astype(np.int64)
        for j in range(WORDS):
            whole = block * WORDS + j
            out += np.where(whole < word, np.bitwise_count(words[whole]), 0)
        return out + np.bitwise_count(words[word] & ((np.uint64(1) << (at % 64).astype(np.uint64)) - np.uint64(1)))

    def access(self, at):
        """The id at a place, or the ids at some."""
        if np.ndim(at) == 0:
            return int(self.access(np.array([at]))[0])
        at = np.asarray(at, np.int64)
        if len(at) and (at.min() < 0 or at.max() >= self.n):
            raise IndexError("no such place")
        out = np.zeros(len(at), np.uint32)
        for k, (words, _) in enumerate(self.planes):
            bit = (words[at // 64] >> (at % 64).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(k, at)
            at = np.where(bit, self._zeros(k) + ones, at - ones)
            out = out * 2 + bit.astype(np.uint32)
        return out

    def _range(self, token: int, lo: int, hi: int) -> tuple[int, int]:
        """Where, below the lowest plane, the token's occurrences among lo..hi stand."""
        if token >> len(self.planes):
            return 0, 0
        ends = np.array([lo, hi], np.int64)
        for k in range(len(self.planes)):
            ones = self._ones(k, ends)
            ends = self._zeros(k) + ones if token >> (len(self.planes) - 1 - k) & 1 else ends - ones
        return int(ends[0]), int(ends[1])

    def count(self, token: int, lo: int = 0, hi: int | None = None) -> int:
        """Occurrences among places lo..hi."""
        a, b = self._range(token, lo, self.n if hi is None else hi)
        return b - a

    def select(self, token: int, ranks):
        """The place of the occurrence with a rank, from 0, or the places of some."""
        if np.ndim(ranks) == 0:
            return int(self.select(token, np.array([ranks]))[0])
        ranks = np.asarray(ranks, np.int64)
        lo, hi = self._range(token, 0, self.n)
        if len(ranks) and not (0 <= ranks.min() and ranks.max() < hi - lo):
            raise IndexError("no such occurrence")
        parts = [self._up(token, lo + ranks[k : k + 4096]) for k in range(0, len(ranks), 4096)]
        return np.concatenate([np.empty(0, np.int64), *parts])

    def _up(self, token: int, at: np.ndarray) -> np.ndarray:
        for k in range(len(self.planes) - 1, -1, -1):
            words, counts = self.planes[k]
            want = token >> (len(self.planes) - 1 - k) & 1
            if want:
                rank, starts, blocks = at - self._zeros(k), counts.astype(np.int64), words
            else:  # zeros; those past the last id come after all others and are never reached
                rank, starts, blocks = at, np.arange(len(counts)) * BLOCK - counts.astype(np.int64), ~words
            block = np.searchsorted(starts, rank, side="right") - 1
            bits = np.unpackbits(blocks.reshape(-1, WORDS)[block].view(np.uint8), axis=1, bitorder="little")
            at = block * BLOCK + (np.cumsum(bits, axis=1, dtype=np.int32) > (rank - starts[block])[:, None]).argmax(1)
        return at

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        now = np.zeros(self.n, self._type(len(self.planes)))
        for k in range(len(self.planes) - 1, -1, -1):
            one = np.unpackbits(self.planes[k][0].view(np.uint8), count=self.n, bitorder="little").view(bool)
            up, zeros = np.empty_like(now), self._zeros(k)
            up[np.flatnonzero(~one)] = now[:zeros]
            up[np.flatnonzero(one)] = now[zeros:] | now.dtype.type(1 << (len(self.planes) - 1 - k))
            now = up
        return now


def dump(ids: np.ndarray, sizes: np.ndarray, docs: list) -> bytes:
    """A shard's file: header; documents' ids and sizes, planes and their counts, each compressed with its length before it."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    matrix = WaveletMatrix.build(ids, bits)
    none = np.array([d is None for d in docs], bool)
    names = np.array([0 if d is None else d for d in docs], "<i8")
    press = zstandard.ZstdCompressor(level=1)
    parts = [np.packbits(none), names, sizes.astype("<i8"), *(x for plane in matrix.planes for x in plane)]
    packed = [press.compress(x.tobytes()) for x in parts]
    return MAGIC + struct.pack("<QQB", len(ids), len(docs), bits) + b"".join(struct.pack("<Q", len(p)) + p for p in packed)


def load(raw: bytes) -> tuple[WaveletMatrix, np.ndarray, list]:
    """(matrix, sizes, doc ids) of a shard's file."""
    if raw[:4] != MAGIC:
        raise ValueError("not a shard")
    n, docs, bits = struct.unpack_from("<QQB", raw, 4)
    at, parts, press = 21, [], zstandard.ZstdDecompressor()
    for _ in range(3 + 2 * bits):
        (size,) = struct.unpack_from("<Q", raw, at)
        parts.append(press.decompress(raw[at + 8 : at + 8 + size]))
        at += 8 + size
    none = np.unpackbits(np.frombuffer(parts[0], np.uint8), count=docs).astype(bool)
    names = [None if x else int(d) for x, d in zip(none, np.frombuffer(parts[1], "<i8"))]
    planes = [(np.frombuffer(w, "<u8"), np.frombuffer(c, "<u4")) for w, c in zip(parts[3::2], parts[4::2])]
    return WaveletMatrix(n, planes), np.frombuffer(parts[2], "<i8"), names


def write(documents: DataFrame, path: str, *, end: int = 2, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """The shards of all documents in ascending doc_id order, stored in the shared folder: part, seq, n_tokens, shard.

    path: a vocabulary of the tokenizers library. Documents are dealt out by ranges of doc_id, so each task writes
    the shards of its range in one pass, holding one shard.
    """
    small_batches(documents.sparkSession)

    def run(batches):
        make, part, seq = encoder(path), TaskContext.get().partitionId(), 0
        docs, sizes, ids, many = [], [], [], 0

        def shard():
            raw = dump(np.concatenate(ids), np.array(sizes), docs)
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([many], pa.int64()), pa.array([raw], pa.binary())], ["part", "seq", "n_tokens", "shard"])

        for b in batches:
            flat, lengths = with_end(*make(b["text"]), end)
            ends = np.cumsum(lengths)
            for doc, size, stop in zip(b["doc_id"].to_pylist(), lengths.tolist(), ends.tolist()):
                if docs and many + size > shard_tokens:
                    yield shard()
                    seq, docs, sizes, ids, many = seq + 1, [], [], [], 0
                docs.append(doc)
                sizes.append(size)
                ids.append(flat[stop - size : stop])
                many += size
        if docs:
            yield shard()

    rows = typed(documents).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return stored(rows.mapInArrow(released(run, path), "part int, seq int, n_tokens long, shard binary"), "shards")


def read(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the stored shards.

    start: ids before it in all shards: sums over parts (as many as the write had tasks) plus sums within its part.
    """
    small_batches(shards.sparkSession)
    sizes = shards.select("part", "seq", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("n")).withColumn("base", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.withColumn("own", F.coalesce(within, F.lit(0))).join(parts.select("part", F.coalesce("base", F.lit(0)).alias("base")), "part")
    rows = shards.select("part", "seq", "shard").join(starts.select("part", "seq", (F.col("base") + F.col("own")).alias("start")), ["part", "seq"])

    def run(batches):
        for b in batches:
            for raw, start in zip(b["shard"], b["start"].to_pylist()):
                matrix, sizes, docs = load(raw.as_py())
                ids = matrix.ids().astype("<u4").view(np.uint8)
                ends = np.cumsum(sizes)
                sums = [zlib.crc32(ids[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(ends - sizes + start), pa.array(sizes), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("shard", "start").mapInArrow(released(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def find(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(doc_id, token, at): every occurrence of some ids, by counting and selecting in the stored shards; at: its place
    in the document. No shard is decoded."""
    small_batches(shards.sparkSession)

    def run(batches):
        for b in batches:
            for raw in b["shard"]:
                matrix, sizes, docs = load(raw.as_py())
                ends = np.cumsum(sizes)
                for token in tokens:
                    places = matrix.select(token, np.arange(matrix.count(token)))
                    doc = np.searchsorted(ends, places, side="right")
                    yield pa.RecordBatch.from_arrays([pa.array([docs[k] for k in doc.tolist()], pa.int64()), pa.array(np.full(len(places), token)), pa.array(places - (ends - sizes)[doc])], ["doc_id", "token", "at"])

    return shards.select("shard").mapInArrow(released(run), "doc_id long, token long, at long")
