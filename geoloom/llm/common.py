"""What the text operators share: the session's shared folder, size-checked joins, and word hashing in numpy.

Words are the runs `[^\\x20\\x09-\\x0D]+` of the UTF-8 text with A-Z lower-cased. A word's name is a 64-bit
polynomial hash of its bytes; a shingle's name is a 64-bit hash of its words' names. Both are the same on every
machine, and every text is hashed whole.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, new_path, shared_dir, stored

__all__ = ["discard", "new_path", "shared_dir", "stored"]

#: A side is broadcast only when its rows times the width stated by the caller stay within this.
BROADCAST_BYTES = 32 << 20
#: Texts of one Arrow batch are hashed in pieces of whole documents of about this many bytes.
CHUNK_BYTES = 1 << 20
EMPTY_U64 = np.empty(0, np.uint64)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches bounded in bytes, the same for all operators, so that long texts stay within a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "4MB")


def typed(documents: DataFrame, *more) -> DataFrame:
    """doc_id as a 64-bit integer, text as a string, and other columns."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def portions(batch: pa.RecordBatch, size: int):
    """Parts of a batch of about so many bytes, a row at least."""
    step = max(1, len(batch) // max(1, -(-batch.nbytes // size)))
    for k in range(0, len(batch), step):
        yield batch.slice(k, step)


def joined(big: DataFrame, side: DataFrame, on: str | list[str], row_bytes: int, how: str = "inner", items: str | None = None) -> DataFrame:
    """Join a stored side: broadcast when its size is within BROADCAST_BYTES, else by a shuffle.

    Its size is row_bytes for each row, and, where rows hold an array `items` of any length, 32 for each element.
    """
    size = F.count("*") * row_bytes + (F.coalesce(F.sum(F.size(items)), F.lit(0)) * 32 if items else 0)
    fits = side.agg(size).first()[0] <= BROADCAST_BYTES
    return big.join(F.broadcast(side) if fits else side, on, how)


_held: dict[str, object] = {}


def held(key: str, make: Callable):
    """A worker's object that is kept from task to task, such as an encoder with its cache; one at a time."""
    if key not in _held:
        _held.clear()
        _held[key] = make()
    return _held[key]


def _give_back() -> None:
    """Freed memory goes back to the system: idle workers hold none of it."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def released(run, holds: str | None = None):
    """The function of a task, which starts without the objects that other operators' tasks held, but for its own of
    key `holds`, and gives freed memory back at its end."""

    def task(batches):
        if holds not in _held:
            _held.clear()
        yield from run(batches)
        _give_back()

    return task


def texts_of(column: pa.Array) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def to_batch(schema: pa.Schema, *arrays) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([a if isinstance(a, (pa.Array, pa.ChunkedArray)) else pa.array(a, f.type) for a, f in zip(arrays, schema)], schema=schema)


# -- hashing ------------------------------------------------------------------------------------------------------

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
_LETTER = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LETTER[65:91] = _LETTER[97:123]  # A-Z as a-z
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of both bases, at least n; a worker keeps those that most texts need."""
    if len(_powers[0]) >= n:
        return _powers
    made = []
    for table, base in zip(_powers, (_BASE, _BASE_INVERSE)):
        step = np.uint64(base)
        while len(table) < n:
            table = np.concatenate([table, table * (table[-1:] * step)])
        made.append(table)
    if n <= 2 * CHUNK_BYTES:
        _powers[:] = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finisher."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_spans(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-last byte of every word."""
    white = np.concatenate([[True], _WHITE[np.frombuffer(text, np.uint8)], [True]])
    edges = np.flatnonzero(white[1:] != white[:-1])
    return edges[::2], edges[1::2]


def hash_words(texts: list[str]):
    """Yield (index of the first text, names of all words of some texts, number of words of each of them)."""
    at = 0
    while at < len(texts):
        end, size, coded = at, 0, []
        while end < len(texts) and (size < CHUNK_BYTES):
            coded.append(texts[end].encode("utf-8", "surrogatepass"))
            size += len(coded[-1]) + 1
            end += 1
        raw = np.frombuffer(b" ".join(coded) + b" ", np.uint8)
        white = _WHITE[raw]
        before = np.empty_like(white)
        before[0], before[1:] = True, white[:-1]
        starts = np.flatnonzero(~white & before)
        ends = np.flatnonzero(white & ~before)
        powers, inverses = _power_tables(len(raw))
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(_LETTER[raw] * powers[: len(raw)], out=total[1:])
        names = mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
        bounds = np.cumsum([len(c) + 1 for c in coded])
        counts = np.diff(np.concatenate([[0], np.searchsorted(starts, bounds)]))
        yield at, names, counts
        at = end


def rolled(names: np.ndarray, width: int) -> np.ndarray:
    """The name of every run of `width` words; empty if there are fewer."""
    if len(names) < width:
        return EMPTY_U64
    out, step = np.zeros(len(names) - width + 1, np.uint64), np.uint64(0xD6E8FEB86659FD93)
    for k in range(width):
        out = out * step + names[k : len(names) - width + 1 + k]
    return mix(out)


def shingle_sets(texts: list[str], width: int = 5):
    """Yield, in order, each text's sorted set of distinct shingle names.

    With fewer words than `width`, the whole sequence is the one shingle; without words the set is empty.
    """
    for _, names, counts in hash_words(texts):
        whole, at = rolled(names, width), 0
        for n in counts.tolist():
            if n >= width:
                yield np.unique(whole[at : at + n - width + 1])
            else:
                yield rolled(names[at : at + n] + np.uint64(n), n) if n else EMPTY_U64
            at += n
