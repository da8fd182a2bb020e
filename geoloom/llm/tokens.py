"""Ids of whole texts by the tokenizers library, with a cache of the pieces that texts are made of.

The library's own encoding of every distinct piece is kept, and texts are put together from pieces. Pieces end
where its pre-tokenizer always ends a token, whatever stands around: for vocabularies that drop white space at ASCII
white space; for byte-level ones before a space that stands between two non-white characters. A text without such a
structure (runs of spaces, odd white space) goes to the library whole. So the ids are those of the whole text.
Strings of special tokens that stand in a text are ordinary text, as the vocabularies' own notes load them.
"""

from __future__ import annotations

import codecs
import json
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import held

#: What a worker's cache may hold, in bytes.
CACHE_BYTES = 12 << 20
#: Longer pieces are encoded anew in each batch.
LONGEST_KEPT = 64
#: Pieces that are encoded as one text, the library's cost being by the call.
TOGETHER = 256
#: Texts that are encoded by one call, so that the library's own results stay small.
CALL = 64
#: A space after which anything but a plain character comes: such a text goes to the library whole.
LOOSE = r" ([^!-~\pL\pN]|$)"
SPACES = r"[ \t\n\r\x0b\x0c]+"
#: Letters of long standing, which every pre-tokenizer takes as one word, and perhaps a mark after them.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{410}-\x{44F}]+[.,;:!?]?$"
MARK = r"([.,;:!?])"

#: The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on; but a line's end
#: becomes the space between the words of a text for the bare model.
PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
OTHERS = [b for b in range(256) if b not in PRINTABLE]
ALPHABET = "".join(" " if b == 10 else chr(b if b in PRINTABLE else 256 + OTHERS.index(b)) for b in range(256))


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Runs of flat, one after another."""
    stops = np.cumsum(sizes)
    total = int(stops[-1]) if len(stops) else 0
    kind = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    at = np.repeat((starts - (stops - sizes)).astype(kind), sizes)
    at += np.arange(total, dtype=kind)
    return flat[at]


class PieceCache:
    """Ids of pieces, held as arrays within a bound in bytes: the least used half goes when it is full."""

    def __init__(self, most: int = CACHE_BYTES):
        self.most, self.names = most, pa.array([], pa.large_string())
        self.sizes, self.used = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def gather(self, pieces: pa.Array, learn) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the pieces (large strings) one after another, and how many each piece has.

        learn: takes an array of distinct pieces, gives all their ids and how many each has.
        """
        coded = pieces.dictionary_encode()
        slots = pc.fill_null(pc.index_in(coded.dictionary, value_set=self.names), -1).to_numpy().astype(np.int64)
        flat, sizes, new = self.flat, self.sizes, np.flatnonzero(slots < 0)
        if len(new):
            unknown = coded.dictionary.take(pa.array(new))
            own, own_sizes = learn(unknown)
            slots[new] = len(sizes) + np.arange(len(new))
            flat, sizes = np.concatenate([flat, own]), np.concatenate([sizes, own_sizes])
        starts = np.cumsum(sizes) - sizes
        order = slots[coded.indices.to_numpy()]
        used = np.bincount(order, minlength=len(sizes))
        used[: len(self.used)] += self.used
        each = sizes[order]
        ids = gathered(flat, starts[order], each)
        if len(new):
            self._keep(pa.concat_arrays([self.names, unknown]), flat, starts, sizes, used)
        else:
            self.used = used
        return ids, each

    def _keep(self, names: pa.Array, flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray, used: np.ndarray):
        lengths = pc.binary_length(names).to_numpy()
        stay = lengths <= LONGEST_KEPT
        cost = lengths + 32 + 4 * sizes
        if cost[stay].sum() > self.most:
            rank = np.argsort(np.where(stay, -used, 1), kind="stable")
            stay[rank[np.searchsorted(np.cumsum(cost[rank]), self.most // 2) :]] = False
            used = used // 2
        if stay.all():
            self.names, self.flat, self.sizes, self.used = names, flat, sizes, used
            return
        at = np.flatnonzero(stay)
        self.names, self.flat, self.sizes, self.used = names.take(pa.array(at)), gathered(flat, starts[at], sizes[at]), sizes[at], used[at]


def joined_ids(rows: list) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, rows), np.int64, len(rows))
    return np.concatenate([np.empty(0, np.uint32), *(np.array(r, np.uint32) for r in rows)]), sizes


def spliced(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """n runs of ids in order, from parts (places, ids, sizes), each with the runs of some places."""
    sizes, starts, base = np.zeros(n, np.int64), np.zeros(n, np.int64), 0
    for places, ids, own in parts:
        sizes[places], starts[places] = own, base + np.cumsum(own) - own
        base += len(ids)
    return gathered(np.concatenate([np.empty(0, np.uint32), *(ids for _, ids, _ in parts)]), starts, sizes), sizes


def together(pieces: pa.Array, between: str) -> pa.Array:
    """Texts of TOGETHER pieces each."""
    offsets = np.append(np.arange(0, len(pieces), TOGETHER), len(pieces))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pieces), pa.scalar(between, pieces.type))


class Ids:
    """Encoder of one worker for one vocabulary file."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import CharDelimiterSplit

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        # the same model, for texts that are words already: a line a word, in the byte-level alphabet
        self.bare = Tokenizer(self.library.model)
        self.bare.pre_tokenizer = CharDelimiterSplit(" ")
        self.drops_white = json.loads(self.library.pre_tokenizer.__getstate__())["type"] == "Sequence"
        size = self.library.get_vocab_size()
        self.edge = np.zeros(size + 1, bool)
        for k in range(size):
            token = self.library.id_to_token(k) or ""
            self.edge[k] = token.endswith("</w>") if self.drops_white else token.startswith("\u0120")
        self.cache = PieceCache()

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [joined_ids([e.ids for e in self.library.encode_batch_fast(texts[k : k + CALL], add_special_tokens=False)]) for k in range(0, len(texts), CALL)]
        return np.concatenate([np.empty(0, np.uint32), *(p[0] for p in parts)]), np.concatenate([np.empty(0, np.int64), *(p[1] for p in parts)])

    def _each(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts that are many and short, each by itself: the library says which of them each id is of."""
        ids, sizes = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for k in range(0, len(texts), TOGETHER):
            group = texts[k : k + TOGETHER]
            made = self.library.encode(group, is_pretokenized=True, add_special_tokens=False)
            ids.append(np.array(made.ids, np.uint32))
            sizes.append(np.bincount(np.array(made.word_ids, np.int64), minlength=len(group)))
        return np.concatenate(ids), np.concatenate(sizes)

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, many as one text where their ends can be told.

        A byte-level piece has one token that starts with its space. In the vocabulary with word ends a run of letters
        is one word, and a final mark another.
        """
        lead = "" if self.drops_white else " "
        plain = pc.match_substring_regex(pieces, PLAIN)
        sure, rest = np.flatnonzero(plain.to_numpy(zero_copy_only=False)), []
        words = pieces.filter(plain)
        marked = pc.count_substring_regex(words, MARK).to_numpy() if self.drops_white else 0
        lines = pc.replace_substring_regex(together(words, "\n" + lead), MARK, "\n\\1").to_pylist()
        lines = [codecs.charmap_decode((lead + (x.lower() if self.drops_white else x)).encode(), "strict", ALPHABET)[0] for x in lines]
        parts = self._split(self.bare, lines, sure, np.ones(len(sure), np.int64) + marked, rest)
        odd = np.flatnonzero(~plain.to_numpy(zero_copy_only=False))
        if self.drops_white:
            rest.append(odd)
        else:
            texts = [lead + x for x in together(pieces.take(pa.array(odd)), " ").to_pylist()]
            parts += self._split(self.library, texts, odd, np.ones(len(odd), np.int64), rest)
        rest = np.sort(np.concatenate([np.empty(0, np.int64), *rest]))
        if len(rest):
            parts.append((rest, *self._each([lead + x for x in pieces.take(pa.array(rest)).to_pylist()])))
        return spliced(parts, len(pieces))

    def _split(self, encoder, texts: list[str], places: np.ndarray, units: np.ndarray, rest: list) -> list:
        """Parts (places, ids, sizes) of texts of pieces with so many edges each; to rest goes what does not add up."""
        parts = []
        for k in range(0, len(texts), CALL):
            for j, made in enumerate(encoder.encode_batch_fast(texts[k : k + CALL], add_special_tokens=False), k):
                group, own = (x[j * TOGETHER : (j + 1) * TOGETHER] for x in (places, units))
                ids = np.array(made.ids, np.uint32)
                edges = np.flatnonzero(self.edge[ids])
                if len(edges) != own.sum():
                    rest.append(group)
                    continue
                stops = edges[np.cumsum(own) - 1] + 1 if self.drops_white else np.append(edges[1:], len(ids))
                parts.append((group, ids, np.diff(stops, prepend=0)))
        return parts

    def __call__(self, texts: pa.Array | list) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has. A null is an empty text."""
        texts = pc.fill_null((texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.large_string()), "")
        n = len(texts)
        if not n:
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if self.drops_white:
            split = pc.split_pattern_regex(texts, SPACES)
            flat = split.flatten()
            apart = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)  # white space at an end of a text
            return self._of_pieces(split, flat, apart, None)
        loose = pc.match_substring_regex(texts, LOOSE).to_numpy(zero_copy_only=False)
        parts = []
        if loose.any():
            parts.append((np.flatnonzero(loose), *self._encode(texts.filter(pa.array(loose)).to_pylist())))
        split = pc.split_pattern(texts.filter(pa.array(~loose)), " ")
        flat = split.flatten()
        apart = np.zeros(len(flat), bool)
        offsets = split.offsets.to_numpy()
        apart[offsets[:-1] - offsets[0]] = True  # a text's first piece has no space before it
        firsts = self._each(flat.filter(pa.array(apart)).to_pylist())
        return spliced([*parts, (np.flatnonzero(~loose), *self._of_pieces(split, flat, apart, firsts))], n)

    def _of_pieces(self, split: pa.ListArray, flat: pa.Array, apart: np.ndarray, others: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts by their pieces; those apart have the other ids given, or none."""
        ids, sizes = self.cache.gather(flat.filter(pa.array(~apart)), self._learn)
        if others:
            ids, each = spliced([(np.flatnonzero(~apart), ids, sizes), (np.flatnonzero(apart), *others)], len(flat))
        else:
            each = np.zeros(len(flat), np.int64)
            each[~apart] = sizes
        offsets = split.offsets.to_numpy().astype(np.int64)
        return ids, np.diff(np.concatenate([[0], np.cumsum(each)])[offsets - offsets[0]])


def encoder(path: str) -> Ids:
    """This worker's encoder, kept from task to task for its cache."""
    return held(path, lambda: Ids(path))


def with_end(ids: np.ndarray, lengths: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """With an end id after each text."""
    return np.insert(ids, np.cumsum(lengths), end).astype(np.uint32), lengths + 1
