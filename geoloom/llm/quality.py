"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - s), thresholds ascending, with one score s shared by all grades: the product
of hashed-text weights with a document's features. Features are hashed words, their shapes (classes of characters,
runs folded), pairs of neighbouring shapes, and words met again within a few words; each counts by the root of its
share of the document. Out come the expected grade and the probability of the upper tail, by which to select.

Edge cases: null and empty text have no features, so s = 0 and the thresholds alone decide; repeated rows get equal
values; with no rating, or a single grade, that grade (0 without any) has probability 1 and all is kept; ratings of
one document that differ count as their largest, and more than MOST_GRADES different ones as that many quantiles;
texts of any length count whole; a null doc_id is graded and never fitted on; documents of equal probability are kept
or rejected alike; empty tables give an empty result; extra columns are ignored by
`grade` and kept by `keep`.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, released, small_batches, texts_of, typed

WORD_BUCKETS, SHAPE_BUCKETS = 1 << 16, 1 << 12
BUCKETS = WORD_BUCKETS + 2 * SHAPE_BUCKETS
CACHE_WORDS = 300_000
#: Beyond so many different ratings they count as the largest of as many quantiles that they reach.
MOST_GRADES = 64


def shape(word: str) -> str:
    """Upper-case, lower-case and digit runs as A, a and 0; other characters stay; runs fold."""
    out = ""
    for c in word:
        c = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out.endswith(c):
            out += c
    return out[:12]


class Features:
    def __init__(self):
        self.seen: dict[str, tuple[int, int]] = {}

    def _new(self, word: str) -> tuple[int, int]:
        coded = word.lower().encode("utf-8", "surrogatepass")
        pair = zlib.crc32(coded) % WORD_BUCKETS, zlib.crc32(shape(word).encode("utf-8", "surrogatepass")) % SHAPE_BUCKETS
        self.seen[word] = pair
        return pair

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        if not words:
            return np.empty(0, np.int64), np.empty(0, np.float32)
        if len(self.seen) > CACHE_WORDS:
            self.seen = {}
        get, new = self.seen.get, self._new
        both = np.array([get(w) or new(w) for w in words], np.int64)
        word, form = both[:, 0], both[:, 1]
        again = np.zeros(len(words), bool)
        for back in range(1, 5):
            again[back:] |= word[back:] == word[:-back]
        pairs = (form[1:] * 31 + form[:-1] * 17 + 5) % SHAPE_BUCKETS
        ids = np.concatenate([word, WORD_BUCKETS + form, WORD_BUCKETS + SHAPE_BUCKETS + pairs, np.full(again.sum(), BUCKETS)])
        ids, counts = np.unique(ids, return_counts=True)
        return ids, np.sqrt(counts / len(words)).astype(np.float32)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray

    def tails(self, s: np.ndarray) -> np.ndarray:
        """P(grade > k) for every k but the last, a row for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - s[:, None], -40, 40)))


def train(features: list[tuple[np.ndarray, np.ndarray]], ratings: np.ndarray, rounds: int = 120, rate: float = 0.05, decay: float = 2e-4) -> Model:
    """Maximum likelihood with a ridge, by Adam over all rows; thresholds are the first and positive gaps."""
    grades = np.unique(ratings)
    if len(grades) < 2:
        return Model(np.zeros(BUCKETS + 1), np.zeros(0), grades if len(grades) else np.zeros(1))
    y = np.searchsorted(grades, ratings)
    row = np.repeat(np.arange(len(features)), [len(i) for i, _ in features])
    ids = np.concatenate([i for i, _ in features]) if len(row) else np.empty(0, np.int64)
    values = np.concatenate([v for _, v in features]).astype(float) if len(row) else np.empty(0)
    below = np.array([(y <= k).mean() for k in range(len(grades) - 1)])
    cuts = np.log(below / (1 - below))
    w, free = np.zeros(BUCKETS + 1), np.concatenate([cuts[:1], np.log(np.maximum(np.diff(cuts), 1e-3))])
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(free), np.zeros_like(free)]
    for t in range(1, rounds + 1):
        cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        s = np.bincount(row, weights=values * w[ids], minlength=len(y))
        padded = np.concatenate([[-np.inf], cuts, [np.inf]])
        hi, lo = (1 / (1 + np.exp(-np.clip(padded[y + k] - s, -40, 40))) for k in (1, 0))
        hi[y == len(cuts)], lo[y == 0] = 1, 0
        p = np.maximum(hi - lo, 1e-12)
        up, down = hi * (1 - hi) / p, lo * (1 - lo) / p
        gs = (up - down) / len(y)
        gw = np.bincount(ids, weights=values * gs[row], minlength=len(w)) + decay * w
        gc = np.array([(-(up * (y == k)).sum() + (down * (y == k + 1)).sum()) / len(y) for k in range(len(cuts))])
        tail = np.cumsum(gc[::-1])[::-1]
        gf = np.concatenate([tail[:1], tail[1:] * np.exp(free[1:])])
        for x, g, m, v in ((w, gw, state[0], state[1]), (free, gf, state[2], state[3])):
            m *= 0.9
            m += 0.1 * g
            v *= 0.99
            v += 0.01 * g * g
            x -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return Model(w, np.cumsum(np.concatenate([free[:1], np.exp(free[1:])])), grades)


def fit(documents: DataFrame, labels: DataFrame, *, label: str = "quality", sample: int = 6000) -> Model:
    """Fit on at most `sample` rated documents of each grade, and 4 * sample together, the first by a hash of their ids."""
    small_batches(documents.sparkSession)
    known = labels.select("doc_id", F.col(label).cast("double").alias("rating")).dropna().groupBy("doc_id").agg(F.max("rating").alias("rating"))
    grades = sorted(r[0] for r in known.select("rating").distinct().limit(MOST_GRADES + 1).collect())
    if len(grades) > MOST_GRADES:
        grades = sorted(set(known.approxQuantile("rating", [k / MOST_GRADES for k in range(MOST_GRADES)], 1e-3)))
        reached = F.array_max(F.filter(F.array(*map(F.lit, grades)), lambda g: g <= F.col("rating")))
        known = known.withColumn("rating", F.coalesce(reached, F.lit(grades[0])))
    if not grades:
        return train([], np.empty(0))
    each = min(sample, -(-4 * sample // len(grades)))
    parts = [known.where(F.col("rating") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for g in grades]
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    rows = typed(documents).join(F.broadcast(picked), "doc_id")  # 5 * sample rows at most

    def extract(batches):
        make = Features()
        for b in batches:
            both = [make.of(t) for t in texts_of(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["rating"], pa.array([i for i, _ in both], pa.list_(pa.int32())), pa.array([v for _, v in both], pa.list_(pa.float32()))], ["doc_id", "rating", "ids", "values"])

    table = rows.mapInArrow(released(extract), "doc_id long, rating double, ids array<int>, values array<float>").toArrow().sort_by([("doc_id", "ascending")])
    ids, values = (table[c].combine_chunks() for c in ("ids", "values"))
    at, flat, shares = ids.offsets.to_numpy(), ids.values.to_numpy(), values.values.to_numpy()
    return train([(flat[a:b], shares[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())], table["rating"].to_numpy())


def _graded(model: Model, s: np.ndarray, tail_from: float) -> tuple[np.ndarray, np.ndarray]:
    """Expected grade, and probability of a grade of tail_from or more."""
    tails = model.tails(s)
    expected = model.grades[0] + tails @ np.diff(model.grades) if len(model.thresholds) else np.full(len(s), float(model.grades[0]))
    k = int(np.searchsorted(model.grades, tail_from))
    return expected, np.ones(len(s)) if k == 0 or not len(model.thresholds) else tails[:, min(k, len(model.thresholds)) - 1]


def grade(documents: DataFrame, labels: DataFrame, *, label: str = "quality", tail_from: float = 1.0, least: float = 0.5, sample: int = 6000, keep_columns: bool = False) -> DataFrame:
    """(doc_id, expected_grade, tail_probability, kept) of every document; kept: tail_probability >= least.

    With keep_columns, the documents' own columns and kept only.
    """
    model = fit(documents, labels, label=label, sample=sample)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def scores(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        make, w = held("quality", Features), sent.value.weights
        s = np.array([float(v @ w[i]) for i, v in map(make.of, texts_of(text))])
        return _graded(sent.value, s.reshape(-1), tail_from)

    if keep_columns:
        def mark(batches):
            for b in batches:
                _, tail = scores(b["text"])
                yield b.filter(pa.array(tail >= least))

        return documents.mapInArrow(released(mark, "quality"), documents.schema)

    def run(batches):
        for b in batches:
            expected, tail = scores(b["text"])
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(expected), pa.array(tail), pa.array(tail >= least)], ["doc_id", "expected_grade", "tail_probability", "kept"])

    return typed(documents).mapInArrow(released(run, "quality"), "doc_id long, expected_grade double, tail_probability double, kept boolean")


def keep(documents: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that are kept, with their own columns."""
    return grade(documents, labels, keep_columns=True, **how)
