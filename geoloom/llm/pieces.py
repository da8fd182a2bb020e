"""SentencePiece encoding and decoding by a merge-type prefix table.

For a BPE vocabulary each prefix of a text has one last token: the token, among those an automaton finds to end
there, that can follow the last token of the prefix before it. Two tokens can stand next to each other if undoing
their merges from the latest on never meets a merge across their border that should have come first. The table is
filled left to right, one token a prefix, and the ids are recovered backwards; time is linear in the text, also
without any space in it.

Texts are cut where no piece reaches across (before a space mark after another character), and each unit's ids are
kept in a bounded cache. Characters outside the vocabulary become their bytes' tokens. Runs of spaces, whose pieces
all tie in score, are merged by rule: best score, then leftmost.

Edge cases: a null doc_id stays null; null and empty text is begin and end id alone, and decodes to the empty text; repeated rows get equal
values; a text of any length is encoded whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import held, released, small_batches, texts_of, typed
from .tokens import PieceCache, joined_ids

MARK = "▁"
UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+$")


@dataclass
class Vocabulary:
    """ids: piece -> id of what merges can make; order: id -> rank of its merge, single characters first;
    parts: id -> the two ids whose merge makes it (itself twice for a character); byte_ids: of the 256 byte tokens.
    """

    ids: dict[str, int]
    order: list[int]
    parts: list[tuple[int, int]]
    byte_ids: list[int]
    surface: list[bytes]
    begin: int
    end: int

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = [model.id_to_piece(i) for i in range(n)]
        ids = {text[i]: i for i in plain}
        order = [0] * n
        for rank, i in enumerate(sorted(plain, key=lambda i: (len(text[i]) > 1, -model.get_score(i), i))):
            order[i] = rank
        score = {text[i]: model.get_score(i) for i in plain}
        surface = [b""] * n
        byte_ids = [0] * 256
        for i in range(n):
            if model.is_byte(i):
                byte_ids[int(text[i][3:5], 16)], surface[i] = i, bytes([int(text[i][3:5], 16)])
        parts: list[tuple[int, int]] = [(i, i) for i in range(n)]
        for i in plain:
            surface[i] = text[i].replace(MARK, " ").encode()
            if len(text[i]) > 1:
                two = merged(text[i], score, stop_at=text[i])
                if two is None:
                    del ids[text[i]]  # no sequence of merges makes it
                else:
                    parts[i] = ids.get(two[0], -1), ids.get(two[1], -1)
        return cls(ids, order, parts, byte_ids, surface, model.bos_id(), model.eos_id())


def merged(text: str, score: dict[str, float], stop_at: str | None = None):
    """Merge by rule; with stop_at, the two pieces of the merge that makes it, or None."""
    parts: list[str | None] = list(text)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap: list = []

    def push(i):
        if after[i] < len(parts) and (s := score.get(parts[i] + parts[after[i]])) is not None:
            heapq.heappush(heap, (-s, i, parts[i] + parts[after[i]]))

    for i in range(len(parts) - 1):
        push(i)
    while heap:
        _, i, made = heapq.heappop(heap)
        if parts[i] is None or after[i] >= len(parts) or parts[i] + parts[after[i]] != made:
            continue
        j = after[i]
        if made == stop_at:
            return parts[i], parts[j]
        parts[i], parts[j], after[i] = made, None, after[j]
        if after[j] < len(parts):
            before[after[j]] = i
        push(i)
        if before[i] >= 0:
            push(before[i])
    return None if stop_at is not None else [p for p in parts if p is not None]


class Codec:
    """Encoder and decoder of one worker."""

    def __init__(self, vocabulary: Vocabulary):
        import ahocorasick

        self.v = v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, i in v.ids.items():
            self.automaton.add_word(piece, (len(piece), i))
        self.automaton.make_automaton()
        self.made = {v.parts[i]: v.order[i] for i in v.ids.values() if v.parts[i][0] != i}
        self.rank_of = {piece: -v.order[i] for piece, i in v.ids.items()}
        self.spaces = {MARK * n: 0.0 for n in range(2, 65) if MARK * n in v.ids}
        self.pairs: dict[int, bool] = {}
        self.longest = np.array([len(s) for s in v.surface], np.int64)
        self.letters = np.frombuffer(b"".join(v.surface), np.uint8)
        self.offsets = np.cumsum(self.longest) - self.longest
        self.letters_known = {p for p in v.ids if len(p) == 1}
        self.piece_size = [0] * len(v.order)
        for piece, i in v.ids.items():
            self.piece_size[i] = len(piece)
        self.cache = PieceCache()

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay apart when their texts are encoded as one."""
        if len(self.pairs) > 1 << 20:
            self.pairs.clear()
        ok = self.pairs[left << 20 | right] = self._compatible(left, right)
        return ok

    def _compatible(self, left: int, right: int) -> bool:
        order, parts, made = self.v.order, self.v.parts, self.made
        # The merge of either token that is undone next comes no earlier than those undone before; a merge across
        # the border that ranks before `bar` would have been made while both of its halves were there.
        bar = 1 << 60
        while True:
            across = made.get((left, right))
            if across is not None and across < bar:
                return False
            undo_left = parts[left][0] != left and (order[left] > order[right] or parts[right][0] == right)
            if undo_left:
                bar, left = order[left], parts[left][1]
            elif parts[right][0] != right:
                bar, right = order[right] + 1, parts[right][0]
            else:
                return True

    def unit(self, text: str) -> list[int]:
        """Ids of a text that no space mark divides."""
        if MARK * 2 in text:
            scored = self.rank_of | {k: -(1 << 40) for k in self.spaces}
            return [i for p in merged(text, scored) for i in ([self.v.ids[p]] if p in self.v.ids else self._bytes(p))]
        last = [-1] * (len(text) + 1)  # -1: nothing ends here yet; -2: the start, or after an unknown character
        last[0] = -2
        if not self.letters_known.issuperset(text):
            for k, c in enumerate(text, 1):
                if c not in self.letters_known:
                    last[k] = -2
        known, compatible = self.pairs.get, self.compatible
        for stop, (n, i) in self.automaton.iter(text):
            stop += 1
            if last[stop] >= 0:
                continue
            before = last[stop - n]
            if before >= 0:
                ok = known(before << 20 | i)
                if compatible(before, i) if ok is None else ok:
                    last[stop] = i
            elif before == -2:
                last[stop] = i
        out: list[int] = []
        at = len(text)
        while at:
            if (i := last[at]) >= 0:
                out.append(i)
                at -= self.piece_size[i]
            else:
                out.extend(reversed(self._bytes(text[at - 1])))
                at -= 1
        out.reverse()
        return out

    def _bytes(self, c: str) -> list[int]:
        return [self.v.byte_ids[x] for x in c.encode("utf-8", "surrogatepass")]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, begin and end ids with them, and how many each text has."""
        if not texts:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        units = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        flat = pa.array(list(itertools.chain.from_iterable(units)), pa.large_string())
        ids, sizes = self.cache.gather(flat, lambda new: joined_ids([self.unit(u) for u in new.to_pylist()]))
        by = np.concatenate([[0], np.cumsum(sizes)])[np.cumsum([0, *map(len, units)])]
        ids = np.insert(ids, np.concatenate([by[:-1], by[1:]]), [self.v.begin] * len(texts) + [self.v.end] * len(texts))
        # np.insert keeps the order of equal places as given: an end id must come before the next begin id
        lengths = np.diff(by) + 2
        stops = np.cumsum(lengths)
        ids[stops - lengths], ids[stops - 1] = self.v.begin, self.v.end
        return ids, lengths

    def decode(self, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of runs of ids: pieces' letters with spaces for marks, without the mark put first."""
        sizes = self.longest[ids]
        ends = np.cumsum(sizes)
        raw = self.letters[np.repeat(self.offsets[ids] - (ends - sizes), sizes) + np.arange(ends[-1] if len(ends) else 0)].tobytes()
        by = np.concatenate([[0], ends])[np.cumsum([0, *lengths.tolist()])].tolist()
        out = []
        for a, b in zip(by[:-1], by[1:]):
            part = raw[a:b]
            out.append(part[1:] if part[:1] == b" " else part)
        return out


def transcode(documents: DataFrame, path: str, *, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every document.

    path: a SentencePiece BPE model. Its tables are read once, on the driver, and sent: they do not grow with data.
    """
    spark = documents.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(Vocabulary.load(path))

    def run(batches):
        codec = held(path, lambda: Codec(sent.value))
        for b in batches:
            ids, lengths = codec.encode(texts_of(b["text"]))
            raw = ids.astype("<u4").view(np.uint8)
            ends = np.cumsum(lengths)
            shas = [hashlib.sha256(raw[4 * (e - n) : 4 * e]).hexdigest() for e, n in zip(ends.tolist(), lengths.tolist())]
            texts = codec.decode(ids, lengths)
            arrays = [b["doc_id"], pa.array(lengths, pa.int64()), pa.array(shas), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
            if with_ids:
                arrays += [pa.array([ids[e - n : e] for e, n in zip(ends.tolist(), lengths.tolist())], pa.list_(pa.int32())), pa.array([t.decode("utf-8", "replace") for t in texts])]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids)

    return typed(documents).mapInArrow(released(run, path), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if with_ids else ""))
