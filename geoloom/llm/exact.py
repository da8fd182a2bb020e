"""Exact dedup by deterministic block naming.

A normalised text (each run of `[\\x20\\x09-\\x0D]` becomes one space) is cut into blocks of fixed size. Equal blocks
meet in one partition, where they are sorted and named by integers in their order; then adjacent names are paired
and the pairs named in the same way, level by level, until every document has one name. Names are ranks of sorted
contents, never hashes, so two documents share a name only if their texts are equal.

Before each shuffle a task folds its equal blocks (or pairs) into one row with the list of their places, at most one
Arrow batch long: a text that fills a third of the corpus costs a row a batch.

Edge cases: null counts as the empty text, whose one block is empty; of equal texts the row with the smallest doc_id
stays, a null doc_id being larger than any number, and of rows that also share the doc_id (repeated rows) exactly
one; an empty table gives an empty result; columns of any name may come along with `keep`.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined, released, small_batches, stored, texts_of, typed

WHITE = re.compile(r"[\x20\x09-\x0D]+")
BLOCK = 1 << 14
_PLACES = "array<struct<uid:long,at:int,of:int>>"
_PLACE_TYPE = pa.list_(pa.struct([("uid", pa.int64()), ("at", pa.int32()), ("of", pa.int32())]))


def normalised(text: str | None) -> str:
    return WHITE.sub(" ", text or "")


def with_uid(df: DataFrame) -> DataFrame:
    """A number for each row; the table it numbers must be stored before the number is used twice."""
    return df.withColumn("uid", F.monotonically_increasing_id())


def _blocks(size: int):
    def run(batches):
        for b in batches:
            places: dict[bytes, list] = {}
            for uid, text in zip(b["uid"].to_pylist(), b["text"].to_pylist()):
                raw = normalised(text).encode("utf-8", "surrogatepass")
                of = max(1, -(-len(raw) // size))
                for at in range(of):
                    places.setdefault(raw[at * size : (at + 1) * size], []).append({"uid": uid, "at": at, "of": of})
            yield pa.RecordBatch.from_arrays([pa.array(list(places), pa.binary()), pa.array(list(places.values()), _PLACE_TYPE)], ["content", "places"])

    return run


def _pairs(batches):
    """Rows (uid, half, names of the two blocks; -1: none), folded by the pair of names."""
    for b in batches:
        places: dict[tuple, list] = {}
        for uid, at, of, left, right in zip(*(b[c].to_pylist() for c in ("uid", "at", "of", "l", "r"))):
            places.setdefault((left, right), []).append({"uid": uid, "at": at, "of": of})
        content = [l.to_bytes(8, "big", signed=True) + r.to_bytes(8, "big", signed=True) for l, r in places]
        yield pa.RecordBatch.from_arrays([pa.array(content, pa.binary()), pa.array(list(places.values()), _PLACE_TYPE)], ["content", "places"])


def _name(batches):
    """Number the distinct contents of a sorted partition; their places stay folded."""
    part, rank, last = TaskContext.get().partitionId(), -1, None
    for b in batches:
        names = []
        for content in b["content"].to_pylist():
            if content != last or last is None:
                rank, last = rank + 1, content
            names.append((part << 40) + rank)
        yield pa.RecordBatch.from_arrays([b["places"], pa.array(names, pa.int64())], ["places", "name"])


def _named(contents: DataFrame) -> DataFrame:
    """Rows (name, uid, at, of), stored folded: the places of one content are unfolded by whoever reads them."""
    dealt = contents.repartition("content").sortWithinPartitions("content")
    return stored(dealt.mapInArrow(_name, f"places {_PLACES}, name long"), "names").select("name", F.inline("places"))


def identities(rows: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(uid, level, name) of rows (uid, text): equal exactly for rows whose normalised texts are equal."""
    small_batches(rows.sparkSession)
    level = 0
    named = _named(rows.select("uid", "text").mapInArrow(released(_blocks(block)), f"content binary, places {_PLACES}"))
    out = named.where("of = 1").selectExpr("uid", "0 level", "name")
    most = named.agg(F.max("of")).first()[0] or 1
    named = named.where("of > 1")
    while most > 1:
        level, most = level + 1, -(-most // 2)
        halves = named.groupBy("uid", F.expr("cast(at div 2 as int)").alias("half"), "of").agg(F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("r"))
        halves = halves.selectExpr("uid", "half at", "cast(ceil(of / 2) as int) of", "l", "r")
        named = _named(halves.mapInArrow(_pairs, f"content binary, places {_PLACES}"))
        out = out.unionByName(named.where("of = 1").selectExpr("uid", f"{level} level", "name"))
        named = named.where("of > 1")
    return out


def groups(documents: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(uid, doc_id, keep_id, group_size, kept) of every row of documents that carry a uid."""
    ids = documents.select("uid", "doc_id")
    names = identities(documents.select("uid", "text"), block=block)
    rows = names.join(ids, "uid")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"), F.col("uid").alias("uid"))
    rows = stored(rows.select("level", "name", "uid", "doc_id"), "named")
    best = rows.groupBy("level", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size")).where("group_size > 1")
    # stored apart from the join, which may then split the rows of a frequent text
    found = joined(rows, stored(best.select("level", "name", "best", "group_size"), "groups"), ["level", "name"], 64, "left")
    alone = F.col("best").isNull()
    return found.select("uid", "doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), (alone | (F.col("uid") == F.col("best.uid"))).alias("kept"))


def dedup(documents: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) of every row."""
    small_batches(documents.sparkSession)

    def digest(batches):
        for b in batches:
            out = [hashlib.sha256(normalised(t).encode("utf-8", "surrogatepass")).hexdigest() for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["uid"], b["doc_id"], pa.array(out)], ["uid", "doc_id", "text_sha256"])

    rows = with_uid(typed(documents))
    digests = rows.mapInArrow(released(digest), "uid long, doc_id long, text_sha256 string")
    return groups(rows, block=block).join(digests.select("uid", "text_sha256"), "uid").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep(documents: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """The rows that stay, with their own columns."""
    rows = documents.select(F.monotonically_increasing_id().alias("uid"), F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"))
    gone = stored(groups(rows.select("uid", "row.doc_id", "row.text"), block=block).where("not kept").select("uid"), "copies")
    return joined(rows, gone, "uid", 40, "left_anti").select("row.*")
