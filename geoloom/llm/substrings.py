"""Suffix-array dedup: sparse suffix arrays over content-selected positions.

Only suffixes that start at a minimiser are kept: of every `span - right + 1` neighbouring 8-word grams the one with
the smallest name, so any passage of `span` words that occurs twice holds, near its start, the same kept suffix in
both places. A suffix is known by the names of its word blocks: first its `right` words, then the words after them.

1. Kept suffixes are sorted by their first block; those whose block occurs once are dropped, which is most of them.
2. Every window of `span` words belongs to one kept suffix, its minimiser, which stands within span - right words of
   its start. The windows of the suffixes that are left are named from the whole texts and sorted by name; those whose
   name occurs once are dropped. The others are all repeats there are, and their unions the passages of any length.
   Of each window the first occurrence by (doc_id, position) is the one that stays.

Sorting spills and runs are read as a stream, so a passage that a third of the corpus shares needs no memory. Blocks and
windows that several documents of a sample have are dealt out by document too: they are known to be met again, and
only the first of each part is compared for the first of all. So no task reads all places of a frequent name. Words are lower-cased runs of non-white characters. Blocks are compared by 64-bit names and windows by 96 bits.

Edge cases: null, empty and short texts have no suffixes; a null doc_id never matches; rows that repeat a doc_id are
one document, whose matches apply to each of them; passages repeated within one document count too; an empty table
gives an empty result; extra columns are ignored by `repeats`, and kept by `cut`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .common import discard, hash_words, joined, mix, released, small_batches, stored, texts_of, typed, word_spans

SPAN, RIGHT, GRAM = 50, 35, 8
#: Names that HITS documents have of a sample (this share of all, and at most so many) are dealt out over SALTS parts.
SAMPLE_SHARE, SAMPLE_DOCUMENTS, HITS, SALTS = 0.02, 20_000, 8, 256
OTHER = np.uint64(0xA0761D6478BD642F)


def block_names(names: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """The name of the `width` words from each start."""
    powers, inverses = common._power_tables(len(names) + 1)
    total = np.concatenate([[np.uint64(0)], np.cumsum(names * powers[: len(names)], dtype=np.uint64)])
    return mix((total[starts + width] - total[starts]) * inverses[starts])


def minimisers(names: np.ndarray, counts: np.ndarray, span: int, right: int) -> tuple[np.ndarray, np.ndarray]:
    """Of every window that lies within one of several texts, its start and its minimiser, as positions in their words."""
    ends = np.cumsum(counts)
    starts = [np.arange(e - c, e - span + 1) for c, e in zip(counts.tolist(), ends.tolist()) if c >= span]
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.concatenate(starts)
    grams = block_names(names, np.arange(len(names) - GRAM + 1), GRAM)
    width = span - right + 1
    return starts, starts + np.lib.stride_tricks.sliding_window_view(grams, width)[starts].argmin(1)


def _suffixes(span: int, right: int, salted=None):
    """Rows (key, doc_id, at[, salt]) of every kept suffix."""

    def run(batches):
        for b in batches:
            b = b.filter(b["doc_id"].is_valid())
            docs = b["doc_id"].to_numpy(zero_copy_only=False)
            for first, names, counts in hash_words(texts_of(b["text"])):
                at = np.unique(minimisers(names, counts, span, right)[1])
                ends = np.cumsum(counts)
                doc = np.searchsorted(ends, at, side="right")
                out = pa.RecordBatch.from_arrays([pa.array(block_names(names, at, right).view(np.int64)), pa.array(docs[first + doc].astype(np.int64)), pa.array((at - (ends - counts)[doc]).astype(np.int32))], ["key", "doc_id", "at"])
                yield salted(out) if salted else out

    return run


def _salted(hot, columns: list[str]):
    """Adds column salt: of places whose name is among the hot ones a number by document, else 0.

    hot: arrays of the names' parts, by the first of them, which differ.
    """

    def mark(b: pa.RecordBatch) -> pa.RecordBatch:
        names = [b[c].to_numpy() for c in columns]
        at = np.minimum(np.searchsorted(hot[0], names[0]), max(0, len(hot[0]) - 1))
        among = np.all([h[at] == n for h, n in zip(hot, names)], axis=0) if len(hot[0]) else np.zeros(len(b), bool)
        salt = np.where(among, 1 + b["doc_id"].to_numpy() % SALTS, 0).astype(np.int32)
        return b.append_column("salt", pa.array(salt))

    return mark


def _hot(places: DataFrame, by: list[str]) -> list[np.ndarray]:
    """Names that a sample's places have in HITS documents or more: fewer than the sample's places by HITS."""
    found = places.groupBy(*by).agg(F.count_distinct("doc_id").alias("n")).where(F.col("n") >= HITS).select(*by).toArrow()
    names = [found[c].to_numpy() for c in by]
    _, first = np.unique(names[0], return_index=True)
    return [n[first] for n in names]


def _met_again(*by: str):
    """Streams rows sorted by (*by, salt, doc_id, at): gives out those whose name, by, has two places or more, and whether
    they are the first. Names with a salt are known to have; of these the first with each salt keeps its name."""
    names = (*by, "salt", "doc_id", "at")

    def run(batches):
        held = None  # the open run's last row, with whether it is the run's first and whether it was given out
        for b in batches:
            cols = [b[c].to_numpy() for c in names]
            if held is not None:
                cols = [np.concatenate([[h], c]) for h, c in zip(held[0], cols)]
            keep = np.ones(len(cols[0]), bool)
            keep[1:] = np.any([c[1:] != c[:-1] for c in cols], axis=0)
            cols = [c[keep] for c in cols]
            salt, doc, at = cols[-3:]
            follows = np.zeros(len(at), bool)
            follows[1:] = np.all([c[1:] == c[:-1] for c in cols[:-2]], axis=0)
            many = follows | (salt > 0)
            many[:-1] |= follows[1:]
            first = ~follows
            given = bool(follows[-1] or salt[-1] > 0) or (len(at) == 1 and held is not None and held[2])
            if held is not None:
                first[0] = held[1]
                many[0] &= not held[2]
            rows = np.flatnonzero(many)
            if len(rows):
                plain = ~(first & (salt > 0))[rows]
                yield pa.RecordBatch.from_arrays([pa.array(doc[rows].astype(np.int64)), pa.array(at[rows].astype(np.int32)), pa.array(first[rows]), *(pa.array(c[rows], mask=plain) for c in cols[:-3])], ["doc_id", "at", "first", *by])
            held = [c[-1] for c in cols], bool(first[-1]), given

    return run


def _windows(span: int, right: int, salted=None):
    """Rows (key, more, doc_id, at[, salt]) of every window whose minimiser is marked; key and more are its name."""

    def run(batches):
        for b in batches:
            docs, marks = b["doc_id"].to_numpy(), b["marks"].to_pylist()
            for start, names, counts in hash_words(texts_of(b["text"])):
                starts, at = minimisers(names, counts, span, right)
                ends = np.cumsum(counts)
                marked = np.zeros(len(names), bool)
                for mine, n, end in zip(marks[start : start + len(counts)], counts.tolist(), ends.tolist()):
                    mine = np.array(mine, np.int64)
                    marked[end - n + mine[mine < n]] = True  # a repeated doc_id may bring marks of another text
                starts = starts[marked[at]]
                doc = np.searchsorted(ends, starts, side="right")
                more = block_names(mix(names + OTHER), starts, span) >> np.uint64(32)
                out = pa.RecordBatch.from_arrays([pa.array(block_names(names, starts, span).view(np.int64)), pa.array(more.astype(np.uint32).view(np.int32)), pa.array(docs[start + doc].astype(np.int64)), pa.array((starts - (ends - counts)[doc]).astype(np.int32))], ["key", "more", "doc_id", "at"])
                yield salted(out) if salted else out

    return run


def _merge(span: int):
    """Streams windows sorted by (doc_id, first, at): maximal ranges, those to be cut and those of first occurrences apart."""

    def ranges(doc, start, stop, kept):
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(stop, pa.int64()), pa.array(kept, pa.bool_())], ["doc_id", "start_word", "end_word", "kept"])

    def run(batches):
        held = None  # the open range's last window, and the range's start
        for b in batches:
            cols = [b[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "first", "at")]
            if held is not None:
                cols = [np.concatenate([[h], c]) for h, c in zip(held[0], cols)]
            doc, first, at = cols
            new = np.ones(len(at), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (first[1:] != first[:-1]) | (at[1:] - at[:-1] > span)
            heads = np.flatnonzero(new)
            starts = at[heads]
            if held is not None:
                starts[0] = held[1]
            done = heads[1:] - 1
            yield ranges(doc[done], starts[:-1], at[done] + span, first[done])
            held = [c[-1] for c in cols], starts[-1]
        if held is not None:
            (doc, first, at), start = held
            yield ranges([doc], [start], [at + span], [first])

    return run


def repeats(documents: DataFrame, *, span: int = SPAN, right: int = RIGHT) -> DataFrame:
    """(doc_id, start_word, n_words, kept): the passages of `span` words or more that occur more than once.

    Ranges of words in the document's whole text; kept: first occurrences of windows of `span` words. Only documents with such passages.
    """
    if not GRAM <= right < span:
        raise ValueError("8 <= right < span is needed")
    small_batches(documents.sparkSession)
    docs = typed(documents)
    share = min(SAMPLE_SHARE, SAMPLE_DOCUMENTS / max(1, docs.count()))

    def sampled(df: DataFrame) -> DataFrame:
        return df.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(share * 1_000_000))

    place, window = "key long, doc_id long, at int", "key long, more int, doc_id long, at int"
    hot = _hot(sampled(docs).mapInArrow(released(_suffixes(span, right)), place), ["key"])
    dealt = docs.mapInArrow(released(_suffixes(span, right, _salted(hot, ["key"]))), f"{place}, salt int").repartition("key", "salt").sortWithinPartitions("key", "salt", "doc_id", "at")
    again = stored(dealt.mapInArrow(_met_again("key"), "doc_id long, at int, first boolean, key long").select("doc_id", "at"), "suffixes")
    marks = stored(again.groupBy("doc_id").agg(F.collect_list("at").alias("marks")), "marks")  # at most a document long
    discard(again)
    rows = joined(docs, marks, "doc_id", 64, items="marks")
    hot = _hot(joined(sampled(docs), marks, "doc_id", 64, items="marks").mapInArrow(released(_windows(span, right)), window), ["key", "more"])
    named = rows.mapInArrow(released(_windows(span, right, _salted(hot, ["key", "more"]))), f"{window}, salt int").repartition("key", "salt").sortWithinPartitions("key", "more", "salt", "doc_id", "at")
    found = named.mapInArrow(_met_again("key", "more"), "doc_id long, at int, first boolean, key long, more int")
    if len(hot[0]):  # of the first places with each salt only one is the first
        found = stored(found, "windows")
        first = found.where("key is not null").groupBy("key", "more").agg(F.min(F.struct("doc_id", "at")).alias("least"))
        found = joined(found, stored(first, "firsts"), ["key", "more"], 40, "left")
        found = found.withColumn("first", F.col("first") & (F.col("least").isNull() | (F.struct("doc_id", "at") == F.col("least"))))
    merged = found.select("doc_id", "at", "first").repartition("doc_id").sortWithinPartitions("doc_id", "first", "at").mapInArrow(_merge(span), "doc_id long, start_word long, end_word long, kept boolean")
    return merged.selectExpr("doc_id", "start_word", "end_word - start_word n_words", "kept")


def without(text: str, ranges: list[tuple[int, int]]) -> str:
    """The text without ranges (first word, number of words)."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends = word_spans(raw)
    out, at = [], 0
    for first, n in sorted(ranges):
        if first >= len(starts):
            continue
        lo, hi = int(starts[first]), int(ends[min(first + n, len(ends)) - 1])
        if hi > at:
            out.append(raw[at : max(at, lo)])
            at = hi
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def unkept(marks: list[dict]) -> list[tuple[int, int]]:
    """The parts of a document's passages (first word, number of words) that are in no passage it keeps."""
    out = []
    stay = sorted((m["start_word"], m["start_word"] + m["n_words"]) for m in marks if m["kept"])
    for m in marks:
        if not m["kept"]:
            at, end = m["start_word"], m["start_word"] + m["n_words"]
            for lo, hi in stay:
                if lo < end and hi > at:
                    if lo > at:
                        out.append((at, lo - at))
                    at = hi
            if at < end:
                out.append((at, end - at))
    return out


def cut(documents: DataFrame, *, span: int = SPAN, right: int = RIGHT) -> DataFrame:
    """The documents without the passages that an earlier document (or place) has, with their own columns.

    The first occurrence of every repeated window of `span` words stays whole, also where a passage to be cut overlaps it.
    An integer column n_chars is set to the new length; a document of which only white characters remain goes. Rows that
    have one doc_id and different texts stay whole, for ranges do not say whose words they count.
    """
    found = repeats(documents, span=span, right=right)
    text = F.xxhash64(F.coalesce("text", F.lit("")))
    several = documents.where("doc_id is not null").groupBy("doc_id").agg(F.min(text).alias("a"), F.max(text).alias("b")).where("a != b").select("doc_id")
    found = found.join(several, "doc_id", "left_anti")
    name = "ranges"
    while name in (c.lower() for c in documents.columns):
        name += "_"
    ranges = stored(found.groupBy("doc_id").agg(F.collect_list(F.struct("start_word", "n_words", "kept")).alias(name)).where(F.exists(name, lambda m: ~m["kept"])), "ranges")
    rows = joined(documents, ranges, "doc_id", 64, "left", items=name).select(*(F.col(f"`{c}`") for c in documents.columns), name)
    fields = documents.columns
    counted = "n_chars" in fields and isinstance(documents.schema["n_chars"].dataType, T.IntegralType)

    def run(batches):
        for b in batches:
            texts, marks = b["text"].to_pylist(), b[name].to_pylist()
            stay, sizes = [], b["n_chars"].to_pylist() if counted else None
            for k, mine in enumerate(marks):
                if mine:
                    texts[k] = without(texts[k], unkept(mine))
                    if counted:
                        sizes[k] = len(texts[k])
                stay.append(not mine or bool(texts[k].strip()))
            new = {"text": pa.array(texts, b["text"].type)} | ({"n_chars": pa.array(sizes, b["n_chars"].type)} if counted else {})
            yield pa.RecordBatch.from_arrays([new.get(c, b[c]) for c in fields], fields).filter(pa.array(stay, pa.bool_()))

    return rows.mapInArrow(released(run), documents.schema)
