"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is its character n-grams (with word-boundary marks) and itself, each hashed into a table of embeddings; a
window of two words is the mean of its n-grams' embeddings, and a linear softmax over that mean gives the probability
of the toxic label. An unseen misspelling shares most n-grams with the words that were seen. A document is toxic if
any of its windows is: the probability is one less the product of what its windows leave, over the whole text, so a
short insult in a long text is not averaged away and several weak signs add up. Table, softmax and bias are fitted
together to the documents' labels through that product. As everything after the table is linear, scoring folds table
and softmax into one number a bucket: exact, and a few hundred KB to broadcast whatever the corpus.

Scores are set so that `threshold` is the cut that served best (F1) on documents that two models, each fitted on the
other half of the sample, had not seen.

Edge cases: null and empty text have no windows and get the softmax of an empty bag, as do texts without word
characters; a text of any length is scored whole; repeated rows get equal scores, and labels of one doc_id that differ
count as their largest; a null doc_id is held out of training and is scored; rows of equal score are equal in
`predicted`; without rows of both labels every score is the smoothed share of toxic rows; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import released, small_batches, texts_of, typed

WORD = re.compile(r"\w+")
WINDOW = 2
#: Words kept in a Python worker's cache.
CACHE_WORDS = 300_000
#: Training documents that a bucket must occur in to have an embedding: others would let the table learn single
#: documents by heart, and keep the zero vector.
LEAST_DOCUMENTS = 3
#: Descent: steps, rate, ridge, and how much more a toxic document counts than a clean one.
STEPS, RATE, RIDGE, TOXIC_WEIGHT = 60, 0.2, 1e-5, 3.0


def subwords(word: str, buckets: int) -> list[int]:
    """Buckets of the word itself and of its n-grams of 3 to 5 characters, boundaries marked."""
    marked = f"<{word}>"
    grams = {marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) % buckets for g in sorted(grams)]


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts of so many words, one after another: the first words of all windows, each text's number of windows,
    and each window's number of words. A text of fewer words than a window is one window; one without words has none."""
    counts = np.where(lengths > WINDOW, lengths - WINDOW + 1, np.minimum(lengths, 1))
    before = np.cumsum(lengths) - lengths
    firsts = np.cumsum(counts) - counts
    lo = np.repeat(before - firsts, counts) + np.arange(counts.sum())
    return lo, counts, np.repeat(np.minimum(lengths, WINDOW), counts)


@dataclass
class Model:
    folded: np.ndarray  # a bucket's embedding times the difference of the softmax's two rows
    bias: float
    shift: float = 0.0  # added to a document's log odds
    learned: bool = True

    def scorer(self):
        return Scorer(self)


class Scorer:
    """Scores texts; keeps words' sums in a bounded cache."""

    def __init__(self, model: Model):
        self.model, self.seen = model, {}

    def _word(self, word: str) -> tuple[float, int]:
        ids = subwords(word, len(self.model.folded))
        self.seen[word] = out = float(self.model.folded[ids].sum()), len(ids)
        return out

    def lefts(self, texts: list[str]) -> np.ndarray:
        """Of each text, what its windows leave, as a negated logarithm."""
        bias, out = self.model.bias, np.full(len(texts), np.logaddexp(0, self.model.bias))
        found = [WORD.findall(t.lower()) for t in texts]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        if not lengths.any() or not self.model.learned:
            return out
        coded = pa.array(list(itertools.chain.from_iterable(found)), pa.large_string()).dictionary_encode()
        if len(self.seen) > CACHE_WORDS:
            self.seen = {}
        get, new = self.seen.get, self._word
        known = np.array([get(w) or new(w) for w in coded.dictionary.to_pylist()])
        sums, sizes = known[coded.indices.to_numpy()].T
        lo, counts, width = windows(lengths)
        top = np.zeros(len(lo))
        full = np.zeros(len(lo))
        for k in range(WINDOW):  # the same sums for equal texts, wherever they stand
            inside = k < width
            top[inside] += sums[lo[inside] + k]
            full[inside] += sizes[lo[inside] + k]
        some = counts > 0
        out[some] = np.add.reduceat(np.logaddexp(0, top / full + bias), (np.cumsum(counts) - counts)[some])
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        return _sigmoid(_log_odds(self.lefts(texts)) + self.model.shift)


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _log_odds(left):
    """Of a document for which the logarithms of what its windows leave sum to -left."""
    return np.where(left > 30, left, np.log(np.maximum(np.expm1(np.minimum(left, 30)), 1e-300)))


class _Sample:
    """Documents as runs of word numbers, and the buckets of each word."""

    def __init__(self, texts: list[str], buckets: int):
        number: dict[str, int] = {}
        self.runs = [np.array([number.setdefault(w, len(number)) for w in t.split()], np.int32) for t in texts]
        subs = [np.array(subwords(w, buckets), np.int32) for w in number]
        self.sizes = np.array([len(s) for s in subs], np.int64)
        self.flat = np.concatenate([np.empty(0, np.int32), *subs])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.buckets = buckets

    def active(self, rows: list[int]) -> np.ndarray:
        """Buckets that occur in LEAST_DOCUMENTS of the documents."""
        seen = np.zeros(self.buckets, np.int32)
        for r in rows:
            words = np.unique(self.runs[r])
            each = self.sizes[words]
            ends = np.cumsum(each)
            seen[np.unique(self.flat[np.repeat(self.starts[words] - (ends - each), each) + np.arange(ends[-1] if len(ends) else 0)])] += 1
        return seen >= LEAST_DOCUMENTS


def _fit(sample: _Sample, rows: list[int], labels: np.ndarray, width: int, seed: int) -> Model:
    """Adam over all documents at once, through every window of each."""
    rng = np.random.default_rng(seed)
    owner = np.repeat(np.arange(len(sample.sizes), dtype=np.int32), sample.sizes)
    kept = sample.active(rows)[sample.flat]
    used, column = np.unique(sample.flat[kept], return_inverse=True)
    owner = owner[kept]
    lengths = np.array([len(sample.runs[r]) for r in rows])
    words = np.concatenate([sample.runs[r] for r in rows])
    lo, counts, size = windows(lengths)
    hi = lo + size
    document = np.repeat(np.arange(len(rows)), counts)
    total = np.concatenate([[0], np.cumsum(sample.sizes[words])])
    full = (total[hi] - total[lo]).astype(float)
    y = labels[rows]
    weight = np.where(y == 1, TOXIC_WEIGHT, 1.0) / len(y)
    table, head, bias = rng.uniform(-1, 1, (len(used), width)) / width, rng.normal(0, 0.3, width), np.array([-4.0])
    state = [(np.zeros_like(x), np.zeros_like(x)) for x in (table, head, bias)]
    for t in range(1, STEPS + 1):
        sums = np.bincount(owner, weights=(table @ head)[column], minlength=len(sample.sizes))
        total = np.concatenate([[0], np.cumsum(sums[words])])
        logits = np.clip((total[hi] - total[lo]) / full + bias[0], -30, 30)
        left = np.bincount(document, weights=np.logaddexp(0, logits), minlength=len(y))
        toxic = np.maximum(-np.expm1(-left), 1e-9)
        back = weight * np.where(y == 1, -np.exp(-left) / toxic, 1.0)
        each = back[document] / (1 + np.exp(-logits))
        share = each / full
        steps = np.bincount(lo, weights=share, minlength=len(words) + 1) - np.bincount(hi, weights=share, minlength=len(words) + 1)
        by_word = np.bincount(words, weights=np.cumsum(steps)[:-1], minlength=len(sample.sizes))
        by_bucket = np.bincount(column, weights=by_word[owner], minlength=len(used))
        slopes = (by_bucket[:, None] * head + RIDGE * table, table.T @ by_bucket, np.array([each.sum()]))
        for x, slope, (mean, square) in zip((table, head, bias), slopes, state):
            mean += 0.1 * (slope - mean)
            square += 0.01 * (slope * slope - square)
            x -= RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.99**t)) + 1e-9)
    folded = np.zeros(sample.buckets, np.float32)
    folded[used] = table @ head
    return Model(folded, float(bias[0]))


def best_cut(odds: np.ndarray, labels: np.ndarray) -> float:
    """The cut, midway between two log odds, from which calling documents toxic has the best F1; the highest of equals."""
    order = np.argsort(-odds, kind="stable")
    odds, hits = odds[order], np.cumsum(labels[order])
    last = np.append(odds[1:] != odds[:-1], True)
    f1 = np.where(last, 2 * hits / (np.arange(1, len(odds) + 1) + labels.sum()), -1)
    k = int(np.argmax(f1))
    return float(odds[k] if k + 1 == len(odds) else (odds[k] + odds[k + 1]) / 2)


def train(texts: list[str], labels: list[int], buckets: int = 1 << 17, width: int = 4, seed: int = 7, threshold: float = 0.7) -> Model:
    """texts: each document's words, lower-case, with a space between."""
    labels = np.array(labels, np.int64)
    share = (labels.sum() + 0.5) / (len(labels) + 1)
    rows = [i for i, t in enumerate(texts) if t]
    if len(set(labels[rows].tolist())) < 2:
        return Model(np.zeros(buckets, np.float32), float(np.log(share / (1 - share))), learned=False)
    sample = _Sample(texts, buckets)
    model = _fit(sample, rows, labels, width, seed)
    halves = [rows[0::2], rows[1::2]]
    if all(len(set(labels[h].tolist())) == 2 for h in halves):
        odds = {}
        for mine, other in (halves, halves[::-1]):
            left = _fit(sample, other, labels, width, seed).scorer().lefts([texts[i] for i in mine])
            odds |= dict(zip(mine, _log_odds(left).tolist()))
        model.shift = float(np.log(threshold / (1 - threshold))) - best_cut(np.array([odds[i] for i in rows]), labels[rows])
    return model


def sample_words(documents: DataFrame, labelled: DataFrame, label: str, per_label: int, words_per_label: int) -> list:
    """(words, label) of at most per_label documents of each label, the first by a hash of their ids, and of these as
    many as have words_per_label words together: bounded, whatever the corpus. labelled: doc_id and an integer label.
    Texts are taken whole; the first document of a label also where it is longer.
    """
    small_batches(documents.sparkSession)
    known = labelled.select("doc_id", F.col(label).cast("int").alias("mark")).dropna().groupBy("doc_id").agg(F.max("mark").alias("mark"))
    picked = [known.where(f"mark {'>' if m else '<='} 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for m in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    rows = typed(documents).join(F.broadcast(picked), "doc_id")  # 2 * per_label rows at most

    def cut(batches):
        for b in batches:
            words = [WORD.findall(t.lower()) for t in texts_of(b["text"])]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["mark"], pa.array([len(w) for w in words], pa.int64()), pa.array([" ".join(w) for w in words])], ["doc_id", "mark", "n", "words"])

    found = rows.mapInArrow(released(cut), "doc_id long, mark int, n long, words string")
    order = F.row_number().over(Window.partitionBy(F.col("mark") > 0).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("words")))
    before = F.sum("n").over(Window.partitionBy(F.col("mark") > 0).orderBy("at"))
    sizes = found.withColumn("at", order).withColumn("so_far", before).where((F.col("so_far") <= words_per_label) | (F.col("at") == 1))
    kept = sizes.select("doc_id", "mark", "words").collect()  # words_per_label words of each label, or one document
    kept.sort(key=lambda r: (r.doc_id, r.words))
    return [(r.words, int(r.mark > 0)) for r in kept]


def score(documents: DataFrame, labels: DataFrame, *, label: str = "toxic", threshold: float = 0.7, per_label: int = 3000, words_per_label: int = 800_000) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document.

    Learns from labelled rows whose crc32(doc_id as text) mod 3 is not 1: per_label documents of each label at most,
    with words_per_label words together.
    """
    out_of = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    found = sample_words(documents, labels.where(~out_of), label, per_label, words_per_label)
    model = train([w for w, _ in found], [m for _, m in found], threshold=threshold)
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(model)

    def run(batches):
        scorer = sent.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["held_out"], pa.array(scorer.scores(texts_of(b["text"])))], ["doc_id", "held_out", "score"])

    scored = typed(documents, out_of.alias("held_out")).mapInArrow(released(run), "doc_id long, held_out boolean, score double")
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
