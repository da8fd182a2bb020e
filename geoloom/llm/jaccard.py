"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

A document's set holds its distinct word 5-gram names. Sets in one global order, rare n-grams first, can only reach
the similarity if their prefixes (n - ceil(t n) + 1 n-grams) share an n-gram, so only prefixes are indexed.

1. One pass gives each row its set's size and name, and counts all n-grams of all documents in a table of
   2**sketch_bits counters (its size is fixed, so it may be broadcast); the counters set the order. Any order is
   right; the counters only make it rare-first.
2. Prefix n-grams are dealt out by n-gram and sorted. In a run of one n-gram, every set is proposed with the run's
   first set (the one whose n-grams are the most frequent, so usually the source of the copies) and with the one
   before it: two pairs a row, however long the run. Equal sets are one vertex from the start.
3. Pairs that pass the length and positional filters are verified once each: the suffix filter, then the sizes of
   the intersections of the whole sets. Components of the links are found.
4. Runs whose sets are still in more than one component are joined in full between different components, under the
   same filters and the suffix filter's bound from the parities of how many n-grams either set has in each of PARTS
   parts of all n-grams; the pairs not yet verified are. Pairs within a component could change nothing, so no link between components is
   lost and copies are never expanded into all pairs.

Sets are known by a 64-bit name of all their n-grams, n-grams by 64-bit names.

Edge cases: null, empty and white texts have an empty set and link with nothing; texts of one to four words are one
shingle; texts of any length are hashed whole; a doc_id with several texts is in the component of each; repeated rows and equal texts share a component; a null doc_id counts as no document and is left out of
`links` (its row has component null); an empty table gives an empty result; extra columns are ignored, and kept by
`keep`.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, joined, mix, released, shingle_sets, small_batches, stored, texts_of, typed
from .components import components

BLOCK_BITS = 16
#: Parts that the n-grams are divided into by their names, for the suffix filter before pairs are made: in at least as
#: many parts as have different parities, the sets differ by an n-gram.
PARTS = 256
PARITIES = ["p0", "p1", "p2", "p3"]
SURVEY = ["doc_id", "n", "name", *PARITIES, "block", "counts"]
PERCENT = 75
_SPAN = np.uint64(0x9E3779B97F4A7C15)


def least_overlap(a, b, percent: int = PERCENT):
    """The smallest intersection of sets of sizes a and b that makes a link: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def set_name(items: np.ndarray) -> int:
    """64-bit signed name of a sorted set."""
    if not len(items):
        return 0
    k = np.arange(len(items), dtype=np.uint64)
    both = mix(items ^ mix(k * _SPAN + np.uint64(len(items))))
    return int(mix(np.array([both.sum(dtype=np.uint64)], np.uint64)).view(np.int64)[0])


def parities(items: np.ndarray) -> np.ndarray:
    """Four 64-bit words, a bit for each part of the n-grams."""
    odd = np.bincount((items & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _survey(bits: int):
    """Rows (doc_id, n, name, parities) of all documents; then the task's counters, a compressed block a row."""

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        empty = pa.nulls
        for b in batches:
            sizes, names, parts, held, many = [], [], [], [], 0
            for items in shingle_sets(texts_of(b["text"])):
                sizes.append(len(items))
                names.append(set_name(items))
                parts.append(parities(items))
                held.append(items)
                many += len(items)
                if many > 1 << 20:
                    counts += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
                    held, many = [], 0
            if held:
                counts += np.bincount((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint32)
            n = len(b)
            words = np.stack(parts, 1) if parts else np.empty((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), *map(pa.array, words), empty(n, pa.int32()), empty(n, pa.binary())], SURVEY)
        width = 1 << min(bits, BLOCK_BITS)
        blocks = counts.reshape(-1, width)
        for k in np.flatnonzero(blocks.any(1)).tolist():
            yield pa.RecordBatch.from_arrays([*(empty(1, pa.int64()) for _ in range(7)), pa.array([k], pa.int32()), pa.array([zlib.compress(blocks[k].tobytes(), 1)])], SURVEY)

    return run


def _summed(batches):
    """Streams blocks sorted by number; holds one of them at a time."""
    now, total = None, None
    for b in batches:
        for k, raw in zip(b["block"].to_pylist(), b["counts"].to_pylist()):
            one = np.frombuffer(zlib.decompress(raw), np.uint32).astype(np.uint64)
            if k != now:
                if now is not None:
                    yield _leveled(now, total)
                now, total = k, one
            else:
                total = total + one
    if now is not None:
        yield _leveled(now, total)


def _leveled(block: int, counts: np.ndarray) -> pa.RecordBatch:
    """Counters on a scale of eighths of powers of two: 255 of them reach 2**31."""
    level = np.minimum(255, np.round(8 * np.log2(counts + 1.0))).astype(np.uint8)
    return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(level.tobytes(), 1)])], ["block", "levels"])


def _prefixes(levels, percent: int, bits: int):
    """Rows (token, name, n, at, centre) of each set's prefix; a task gives each set of a batch once.

    centre: the set's mean level, negated. The source of many near copies has none of their own n-grams, so it has the
    highest level of them all, also where other n-grams share its counters.
    """

    def run(batches):
        table = levels.value
        for b in batches:
            seen, out = set(), [[], [], [], [], []]
            for items in shingle_sets(texts_of(b["text"])):
                n, name = len(items), set_name(items)
                if not n or name in seen:
                    continue
                seen.add(name)
                level = table[(items >> np.uint64(64 - bits)).astype(np.int64)]
                size = n - least_overlap_self(n, percent) + 1
                order = np.argsort((level.astype(np.uint64) << np.uint64(56)) | (items >> np.uint64(8)), kind="stable")[:size]
                out[0].append(items[order].view(np.int64))
                out[1].append(np.full(size, name))
                out[2].append(np.full(size, n, np.int32))
                out[3].append(np.arange(size, dtype=np.int32))
                out[4].append(np.full(size, -round(1000 * float(level.mean())), np.int32))
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["token", "name", "n", "at", "centre"])

    return run


def least_overlap_self(n: int, percent: int) -> int:
    """The smallest intersection that a set of size n can have with any set it links with: ceil(percent n / 100)."""
    return -(-percent * n // 100)


def _passes(n1, at1, n2, at2, percent):
    """Length and positional filters, on arrays.

    From the first n-gram that two sets share on, both must have as many n-grams left as a link needs. A linked pair
    passes where that n-gram's run is; at later ones it need not.
    """
    lo, hi = np.minimum(n1, n2), np.maximum(n1, n2)
    return (100 * lo >= percent * hi) & (np.minimum(n1 - at1, n2 - at2) >= least_overlap(n1, n2, percent))


def _propose(percent: int):
    """Streams rows sorted by token; keeps those whose token occurs in two sets or more.

    Adds to each the names of the run's first set and of the set before it, null where the filters say no. Whatever
    the length of a run, two rows of it are held.
    """
    names = ["token", "name", "n", "at", "first", "before"]

    def run(batches):
        head = prev = None  # of the run that is still open: its first row and its last, as tuples
        shown = False  # the first row of the open run has been given out
        for b in batches:
            cols = [b[c].to_numpy() for c in ("token", "name", "n", "at")]
            if prev is not None:
                cols = [np.concatenate([[p], c]) for p, c in zip(prev, cols)]
            keep = np.ones(len(cols[0]), bool)
            keep[1:] = (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])
            cols = [c[keep] for c in cols]
            token, name, n, at = (c.astype(np.int64) for c in cols)
            new = np.ones(len(token), bool)
            new[1:] = token[1:] != token[:-1]
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), 0))
            f = [c[start] for c in (name, n, at)]
            if head is not None:
                mine = token == head[0]
                for k, c in enumerate(f):
                    c[mine] = head[k + 1]
            p = [np.concatenate([c[:1], c[:-1]]) for c in (name, n, at)]
            follows = ~new
            with_first = follows & (f[0] != name) & _passes(n, at, f[1], f[2], percent)
            with_before = follows & (p[0] != name) & (p[0] != f[0]) & _passes(n, at, p[1], p[2], percent)
            many = follows.copy()
            many[:-1] |= follows[1:]
            if prev is not None:
                many[0] = many[0] and not shown  # carried over: given out before, unless it was alone
            last_shown = bool(follows[-1]) or (len(token) == 1 and shown)
            rows = np.flatnonzero(many)
            if len(rows):
                yield pa.RecordBatch.from_arrays([*(pa.array(c[rows]) for c in (token, name, n, at)), pa.array(f[0][rows], mask=~with_first[rows]), pa.array(p[0][rows], mask=~with_before[rows])], names)
            head = (token[-1], f[0][-1], f[1][-1], f[2][-1])
            prev, shown = (token[-1], name[-1], n[-1], at[-1]), last_shown

    return run


def hamming_bound(x: np.ndarray, y: np.ndarray, depth: int = 3) -> int:
    """Suffix filter: a lower bound of the symmetric difference of sorted sets, by halving both at y's median."""
    if depth == 0 or len(x) == 0 or len(y) == 0:
        return abs(len(x) - len(y))
    mid = len(y) // 2
    cut = int(np.searchsorted(x, y[mid]))
    same = cut < len(x) and x[cut] == y[mid]
    return hamming_bound(x[:cut], y[:mid], depth - 1) + hamming_bound(x[cut + same :], y[mid + 1 :], depth - 1) + (not same)


def similar(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    need = least_overlap(len(x), len(y), percent)
    if (len(x) + len(y) - hamming_bound(x, y)) // 2 < need:
        return False
    return len(np.intersect1d(x, y, assume_unique=True)) >= need


def _verify(documents: DataFrame, pairs: DataFrame, owners: DataFrame, percent: int) -> DataFrame:
    """Those of the stored pairs (a, b) of set names that reach the similarity, from the whole texts.

    owners: (name, doc_id), one document for each name.
    """
    wanted = pairs.selectExpr("a name").union(pairs.selectExpr("b name")).distinct()
    wanted = stored(owners.join(wanted, "name", "left_semi"), "wanted")
    rows = joined(typed(documents), wanted, "doc_id", 24)

    def sets(batches):
        for b in batches:
            found = list(shingle_sets(texts_of(b["text"])))
            own = pa.array([set_name(s) == n for s, n in zip(found, b["name"].to_pylist())], pa.bool_())  # a repeated doc_id may bring another text
            yield pa.RecordBatch.from_arrays([b["name"], pa.array([s.tobytes() for s in found], pa.binary())], ["name", "items"]).filter(own)

    # not stored: one shuffle by name serves both joins
    found = rows.mapInArrow(released(sets), "name long, items binary").dropDuplicates(["name"])

    def check(batches):
        for b in batches:
            ok = [similar(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(b["x"].to_pylist(), b["y"].to_pylist())]
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b["a"].filter(mask), b["b"].filter(mask)], ["a", "b"])

    both = pairs.join(found.selectExpr("name a", "items x"), "a").join(found.selectExpr("name b", "items y"), "b")
    out = stored(both.select("a", "b", "x", "y").mapInArrow(released(check), "a long, b long"), "links")
    discard(wanted)
    return out


def _indexed(documents: DataFrame, percent: int, sketch_bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(survey, names, runs): rows (doc_id, n, name) of all documents; of each set its smallest doc_id and parities; and
    the prefix n-grams that several sets have, with the proposals of their runs."""
    spark = documents.sparkSession
    small_batches(spark)
    survey = stored(documents.mapInArrow(released(_survey(sketch_bits)), "doc_id long, n long, name long, p0 long, p1 long, p2 long, p3 long, block int, counts binary"), "survey")
    blocks = survey.where("block is not null").select("block", "counts").repartition("block").sortWithinPartitions("block").mapInArrow(_summed, "block int, levels binary").collect()
    levels = np.zeros((max(1, (1 << sketch_bits) >> BLOCK_BITS), 1 << min(sketch_bits, BLOCK_BITS)), np.uint8)
    for r in blocks:
        levels[r.block] = np.frombuffer(zlib.decompress(r.levels), np.uint8)
    sent = spark.sparkContext.broadcast(levels.ravel())  # 2**sketch_bits bytes, whatever the corpus
    survey = survey.where("block is null").select("doc_id", "n", "name", *PARITIES)
    names = survey.where("n > 0 and doc_id is not null").groupBy("name").agg(F.min("doc_id").alias("doc_id"), *(F.min(p).alias(p) for p in PARITIES))
    index = documents.mapInArrow(released(_prefixes(sent, percent, sketch_bits)), "token long, name long, n int, at int, centre int")
    dealt = index.repartition("token").sortWithinPartitions("token", "centre", "name")
    runs = stored(dealt.mapInArrow(_propose(percent), "token long, name long, n long, at long, first long, before long"), "runs")
    return survey.drop(*PARITIES), stored(names, "sets"), runs


def _candidates(rows: DataFrame, names: DataFrame, percent: int, apart: str) -> tuple[DataFrame, DataFrame]:
    """(stored rows with parities, pairs a < b of sets that share an n-gram of rows and pass all filters). apart: a
    condition on x and y that takes one of the two orders of a pair."""
    rest = stored(rows.where("(n - at) * {0} >= n * {1}".format(100, percent)).join(names.drop("doc_id"), "name"), "open")
    x, y = rest.alias("x"), rest.alias("y")
    differ = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in PARITIES)
    fits = F.expr(f"{apart} and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n) and {100 + percent} * least(x.n - x.at, y.n - y.at) >= {percent} * (x.n + y.n) and {100 + percent} * ({differ}) <= {100 - percent} * (x.n + y.n)")
    return rest, x.join(y, (F.col("x.token") == F.col("y.token")) & fits).selectExpr("least(x.name, y.name) a", "greatest(x.name, y.name) b").distinct()


def links(documents: DataFrame, *, percent: int = PERCENT, sketch_bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """(survey, graph): rows (doc_id, n, name) of all documents, and (node, component) of set names that have links."""
    docs = typed(documents)
    survey, names, runs = _indexed(docs, percent, sketch_bits)
    owners = names.select("name", "doc_id")
    pairs = runs.selectExpr("least(name, first) a", "greatest(name, first) b").union(runs.selectExpr("least(name, before) a", "greatest(name, before) b")).where("a is not null and a != b")
    # least and greatest skip nulls: a row without a proposal pairs with itself
    pairs = stored(pairs.distinct(), "pairs")
    good = _verify(docs, pairs, owners, percent)
    known = stored(components(good), "components")

    placed = runs.select("token", "name", "n", "at").join(known.withColumnRenamed("node", "name"), "name", "left").withColumn("component", F.coalesce("component", "name"))
    placed = stored(placed, "placed")
    open_runs = placed.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    rest, more = _candidates(placed.join(open_runs, "token", "left_semi"), names, percent, "x.component < y.component")
    more = stored(more.join(pairs, ["a", "b"], "left_anti"), "more")
    late = _verify(docs, more, owners, percent)
    graph = stored(components(good.union(late)), "components")
    discard(names, runs, pairs, good, known, placed, rest, more, late)
    return survey, graph


def linked_pairs(documents: DataFrame, *, percent: int = PERCENT, sketch_bits: int = 22) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): every link (a, b) between different sets, by their names, each verified once; and the documents
    (doc_id, name) that have each set. Equal texts are one set and are not paired.

    The join itself, for whoever needs each link: among n texts that are all near copies of each other there are
    n (n - 1) / 2. `classes` finds which documents belong together without making them all.
    """
    docs = typed(documents)
    survey, names, runs = _indexed(docs, percent, sketch_bits)
    rest, found = _candidates(runs.select("token", "name", "n", "at"), names, percent, "x.name < y.name")
    found = stored(found, "pairs")
    pairs = _verify(docs, found, names.select("name", "doc_id"), percent)
    discard(names, runs, rest, found)
    return pairs, survey.where("n > 0 and doc_id is not null").select("doc_id", "name")


def classes(documents: DataFrame, *, percent: int = PERCENT, sketch_bits: int = 22) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; component_id: the smallest doc_id reachable by links."""
    survey, graph = links(documents, percent=percent, sketch_bits=sketch_bits)
    vertex = survey.join(graph.withColumnRenamed("node", "name"), "name", "left").withColumn("vertex", F.when(F.col("n") > 0, F.coalesce("component", "name")))
    vertex = stored(vertex, "vertices")
    least = vertex.where("vertex is not null").groupBy("vertex").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows"))
    least = stored(least.where("rows > 1"), "least")  # apart from the join, which may then split a large component
    out = joined(vertex, least.drop("rows"), "vertex", 24, "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def keep(documents: DataFrame, *, percent: int = PERCENT, sketch_bits: int = 22) -> DataFrame:
    """One document of each component, that with the smallest doc_id, with its own columns.

    Documents without words are linked with nothing and all stay, as do rows without doc_id; of repeated rows with
    one doc_id all that share the smallest stay (exact dedup is another operator), and rows that have one doc_id and
    different texts go only if each of them would.
    """
    stays = F.max(F.col("doc_id") == F.col("component_id"))
    gone = classes(documents, percent=percent, sketch_bits=sketch_bits).where("doc_id is not null").groupBy("doc_id").agg(stays.alias("stays")).where("not stays").select("doc_id")
    return joined(documents, stored(gone, "copies"), "doc_id", 24, "left_anti")
