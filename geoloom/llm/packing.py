"""Packing: vector bin packing of token sequences by the dot-product heuristic.

A sequence has three limits at once: tokens, segments and loss-bearing tokens. Every item is a vector of its demands
as shares of the limits, every open sequence a vector of what is left; an item goes to the sequence, among those
that can take it whole, where the dot product of the two is largest. An item that no open sequence can take is cut
to fill the one with the most room, as long as that one may have another segment. Full sequences close.

Each task packs its own documents as a stream, with a bounded number of open sequences and nothing to shuffle; at its
end the remaining pieces are cut over again so that all but the last sequences are full. What is left then fills
sequences whose sizes are powers of two, which need no padding. The same input split gives the same sequences again.

Edge cases: null and empty texts are their end id alone; documents longer than a sequence fill whole sequences
first; repeated rows are packed each; a null doc_id is packed like any other and stays null; documents of equal length
are packed in their order; an item that bears no loss (loss_from past its end) only counts tokens and a
segment; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, typed
from .tokens import encoder, with_end


@dataclass(frozen=True)
class Limits:
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Packer:
    """items: (key, start, stop, loss_from): ids start..stop of a document, those from loss_from on bear loss."""

    def __init__(self, limits: Limits, most_open: int = 64):
        self.limits, self.most_open = limits, most_open
        self.scale = np.array([limits.tokens, limits.segments, limits.loss], float)
        self.left = np.zeros((0, 3), np.int64)
        self.open: list[list] = []
        self.closed: list[tuple[list, bool]] = []

    def _demand(self, start: int, stop: int, loss_from: int) -> tuple[int, int, int]:
        return stop - start, 1, max(0, stop - max(start, loss_from))

    def _put(self, k: int, item: tuple):
        self.open[k].append(item)
        self.left[k] -= self._demand(*item[1:])
        if self.left[k].min() <= 0:
            self.closed.append(self.open.pop(k))
            self.left = np.delete(self.left, k, 0)

    def _room(self, k: int, start: int, stop: int, loss_from: int) -> int:
        """Ids of the item, from its start, that sequence k can still take."""
        tokens, segments, loss = self.left[k].tolist()
        return 0 if segments < 1 else min(stop - start, tokens, max(0, loss_from - start) + loss)

    def add(self, key, start: int, stop: int, loss_from: int):
        while start < stop:
            need = np.array(self._demand(start, stop, loss_from))
            fits = np.flatnonzero((self.left >= need).all(1)) if len(self.open) else ()
            if len(fits):
                k = fits[np.argmax((self.left[fits] / self.scale) @ (need / self.scale))]
                return self._put(int(k), (key, start, stop, loss_from))
            if len(self.open) < self.most_open:
                self.open.append([])
                self.left = np.vstack([self.left, self.scale.astype(np.int64)[None]])
                k = len(self.open) - 1
            else:
                k = int(np.argmax(self.left[:, 0] / self.scale[0] + self.left[:, 2] / self.scale[2]))
            take = self._room(k, start, stop, loss_from)
            self._put(k, (key, start, start + take, loss_from))
            start += take

    def finish(self):
        """Empty the least filled sequences into the others, cutting pieces, then close those left at powers of two."""
        while len(self.open) > 1:
            k = int(np.argmax(self.left[:, 0]))
            items = self.open.pop(k)
            self.left = np.delete(self.left, k, 0)
            while items:
                key, start, stop, loss_from = items.pop()
                while start < stop and self.open:
                    rooms = [self._room(j, start, stop, loss_from) for j in range(len(self.open))]
                    j = int(np.argmax(rooms))
                    if rooms[j] == 0:
                        break
                    self._put(j, (key, start, start + rooms[j], loss_from))
                    start += rooms[j]
                if start < stop:
                    items.append((key, start, stop, loss_from))
                    break
            if items:
                self._close_last(items)
        for items in self.open:
            self._close_last(items)
        self.open, self.left = [], self.left[:0]

    def _close_last(self, items: list):
        """Cut a run of pieces at powers of two of its length."""
        size = sum(stop - start for _, start, stop, _ in items)
        if not size or size == self.limits.tokens:
            return self.closed.append(items) if size else None
        part, room = [], 1 << (size.bit_length() - 1)
        for key, start, stop, loss_from in items:
            while start < stop:
                take = min(stop - start, room)
                part.append((key, start, start + take, loss_from))
                start, room, size = start + take, room - take, size - take
                if not room:
                    self.closed.append(part)
                    part, room = [], 1 << max(0, size.bit_length() - 1)

    def take(self):
        out, self.closed = self.closed, []
        return out


COLUMNS = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "loss_tokens"]
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack(documents: DataFrame, path: str, *, limits: Limits = Limits(), end: int = 2, loss_from: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens[, ids].

    path: a vocabulary of the tokenizers library; each text's ids are followed by `end`. loss_from: an integer column
    with the first id that bears loss (else all do), as in instruction data whose prompt bears none.
    """
    small_batches(documents.sparkSession)
    marked = F.lit(0).cast("long") if loss_from is None else F.coalesce(F.col(f"`{loss_from}`").cast("long"), F.lit(0))
    rows = typed(documents, marked.alias("loss_from"))

    def run(batches):
        make, packer = encoder(path), Packer(limits)
        base, n, held = TaskContext.get().partitionId() << 33, 0, {}

        def give(sequences):
            nonlocal n
            out = [[] for _ in range(9)]
            for items in sequences:
                at = 0
                for key, start, stop, loss in items:
                    doc, ids, waits = held[key]
                    piece = ids[start:stop].astype("<u4").tobytes()
                    for c, v in zip(out, (doc, start, stop - start, zlib.crc32(piece), len(ids), base + n, at, max(0, stop - max(start, loss)), piece)):
                        c.append(v)
                    at += stop - start
                    waits[0] -= stop - start
                    if not waits[0]:
                        del held[key]
                n += 1
            arrays = [pa.array(c, pa.int64()) for c in out[:8]] + ([pa.array(out[8], pa.binary())] if with_ids else [])
            return pa.RecordBatch.from_arrays(arrays, COLUMNS + ["ids"] * with_ids)

        key = 0
        for b in batches:
            ids, sizes = with_end(*make(b["text"]), end)
            ends = np.cumsum(sizes)
            order = []
            for doc, size, stop, loss in zip(b["doc_id"].to_pylist(), sizes.tolist(), ends.tolist(), b["loss_from"].to_pylist()):
                held[key] = (doc, ids[stop - size : stop].copy(), [size])
                order.append((-size, key, loss))
                key += 1
            for size, k, loss in sorted(order):
                packer.add(k, 0, -size, loss)
            yield give(packer.take())
        packer.finish()
        yield give(packer.take())

    return rows.mapInArrow(released(run, path), SCHEMA + (", ids binary" if with_ids else ""))
