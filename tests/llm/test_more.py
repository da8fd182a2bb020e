"""Frequent passages, odd records and ratings, look-ups in shards, loss limits, and the pipeline against brute force."""

import collections
import json
import random
import re
import zlib

import numpy as np
import pytest

from geoloom.llm import chat, jaccard, packing, quality, substrings, tokens, toxicity, wavelet
from tests.llm.test_llm import labelled, prose, rows, windows, words

public_tokenizers = pytest.importorskip("public_tokenizers")


def covered(ranges):
    out = {k: collections.defaultdict(set) for k in (True, False)}
    for r in ranges:
        out[r.kept][r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    return out


def test_frequent_passages_are_dealt_out(spark, monkeypatch):
    """Passages that a third of all documents have: the same ranges, kept flags included, as by brute force."""
    monkeypatch.setattr(substrings, "SAMPLE_SHARE", 0.4)
    r, often, half = random.Random(1), prose(60, 90), prose(61, 60)
    texts = {}
    for d in range(300):
        parts = [prose(1000 + d, r.randrange(0, 40))]
        if d % 3 == 0:
            parts.append(often if d % 2 else " ".join(often.split()[:62]))
        if d % 7 == 0:
            parts.append(half)
        texts[d] = " ".join([*parts, prose(2000 + d, 20)])
    want = {k: collections.defaultdict(set) for k in (True, False)}
    for places in windows(texts).values():
        for k, (d, i) in enumerate(places):
            want[k == 0][d].update(range(i, i + 50))
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    assert covered(substrings.repeats(df).collect()) == want and sum(map(len, want[False].values())) > 8000
    monkeypatch.setattr(substrings, "SAMPLE_SHARE", 0.0)
    assert covered(substrings.repeats(df).collect()) == want


def test_one_doc_id_with_several_texts_is_not_cut(spark):
    shared, other = prose(62, 60), prose(63, 90)
    data = [(1, f"{prose(64, 5)} {shared}"), (5, f"{prose(65, 9)} {shared}"), (5, other), (5, None), (7, f"{shared} {prose(66, 8)}"), (None, shared)]
    left = sorted(((r.doc_id or 0, r.text or "") for r in substrings.cut(spark.createDataFrame(data, "doc_id long, text string")).collect()))
    assert left == sorted(((d or 0, (t or "") if d != 7 else " " + prose(66, 8)) for d, t in data))


def test_sources_of_near_copies_come_first(spark):
    """Copies with edits of their own, which are too far from each other: all are of the source's component."""
    r, source = random.Random(2), prose(70, 160).split()
    texts = {500: " ".join(source)}
    for d in range(60):
        own = list(source)
        for k in sorted(r.sample(range(160), 3)):
            own[k] = f"edit{d}x{k}"
        texts[d] = " ".join(own)
    sets = {d: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} for d, w in ((d, words(t)) for d, t in texts.items())}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    got = {x.doc_id: x.component_id for x in jaccard.classes(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4), sketch_bits=16).collect()}
    best = {d: d for d in sets}
    for _ in sets:
        for a, b in links:
            best[a] = best[b] = min(best[a], best[b])
    assert got == best and len(links) > 60


def test_one_doc_id_with_a_copy_and_another_text_stays(spark):
    data = [(3, prose(67, 40)), (5, prose(67, 40) + " more"), (5, prose(68, 40)), (6, prose(67, 40) + " still more")]
    left = sorted((r.doc_id, r.text) for r in jaccard.keep(spark.createDataFrame(data, "doc_id long, text string"), sketch_bits=16).collect())
    assert left == sorted(data[:3])


def test_every_link_between_different_texts(spark):
    source = prose(71, 80).split()
    texts = {i: " ".join(source[:k] + [f"w{i}"] + source[k + 1 :]) for i, k in enumerate((3, 9, 30, 31, 32, 60, 75))} | {20: " ".join(source), 21: " ".join(source), 22: prose(72, 50), 23: "", 24: None, 25: "two words", 26: "two words"}
    pairs, members = jaccard.linked_pairs(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), sketch_bits=16)
    sets = {d: frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []) for d, w in ((d, words(t)) for d, t in texts.items())}
    by = collections.defaultdict(set)
    for m in members.collect():
        by[m.name].add(sets[m.doc_id])
    assert all(len(s) == 1 for s in by.values()) and sum(map(len, by.values())) == len({s for s in sets.values() if s})
    got = [frozenset(next(iter(by[n])) for n in (r.a, r.b)) for r in pairs.collect()]
    want = {frozenset((x, y)) for x in sets.values() for y in sets.values() if x != y and x and 100 * len(x & y) >= 75 * len(x | y)}
    assert set(got) == want and len(got) == len(want) > 15


def test_parities_bound_the_difference():
    r = np.random.default_rng(3)
    for _ in range(100):
        x, y = (np.unique(r.integers(0, 1 << 62, r.integers(1, 400)).astype(np.uint64)) for _ in "xy")
        y = np.unique(np.concatenate([y, x[: len(x) // 2]]))
        differ = int(np.bitwise_count(jaccard.parities(x).view(np.uint64) ^ jaccard.parities(y).view(np.uint64)).sum())
        assert differ <= len(np.setxor1d(x, y)) and differ % 2 == len(np.setxor1d(x, y)) % 2


def test_odd_records(spark):
    deep = "[" * 100_000 + "]" * 100_000
    turn = {"role": "user", "text": "x"}
    records = [json.dumps({"conv_id": c, "turn": 0, **turn}) for c in ("abc", 7, "8", 1 << 70, True, 1.5)]
    records += [deep, '{"a":' * 5000 + "1" + "}" * 5000, '{"messages":[]}', '{"messages":[{"role":"user","content":null}]}', json.dumps({"conv_id": 9, "turn": "z", **turn})]
    out = chat.format_records(spark.createDataFrame([(r, 100 + k) for k, r in enumerate(records)], "record string, conv_id long"))
    got = {r.conv_id: r.n_turns for r in chat.digests(out).collect()}
    ids = [chat.conversation_id(c) for c in ("abc", 7, "8", 1 << 70, True, 1.5)]
    assert ids[1:3] == [7, 8] and len(set(ids)) == 6
    assert got == dict.fromkeys(ids, 1) | {106: 0, 107: 0, 108: 0, 109: 1, 9: 1}
    assert chat.digests(out.where("1 = 0")).count() == 0


def test_repeated_and_long_turns(spark):
    said = "a [INST] b </s> " * 20_000
    turns = [(1, 0, "user", "q"), (1, 1, "assistant", said), (1, 1, "assistant", said), (1, 1, "user", "tie")]
    got = chat.digests(chat.format_conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).first()
    assert got.n_turns == 4 and got.loss_chars == 2 * len(said)


def test_continuous_ratings(spark):
    r = random.Random(4)
    data = [(i, " ".join(r.choice("good fine nice".split() if i % 2 else "bad poor grim".split()) for _ in range(30)), float(i % 2) + r.random() / 2) for i in range(400)]
    docs = spark.createDataFrame([d[:2] for d in data] + [(None, "good")], "doc_id long, text string")
    labels = spark.createDataFrame([(d[0], d[2]) for d in data], "doc_id long, quality double")
    got = quality.grade(docs, labels, tail_from=0.75).collect()
    assert sum(g.kept == (g.doc_id % 2 == 1) for g in got if g.doc_id is not None) > 390 and len(got) == 401
    model = quality.train([(np.array([k]), np.ones(1, np.float32)) for k in (1, 2, 3) for _ in range(50)], np.repeat([0.0, 1.0, 5.0], 50))
    s = np.array([model.weights[k] for k in (1, 2, 3)])
    expected, tail = quality._graded(model, s, 5.0)
    assert s[0] < s[1] < s[2] and expected[0] < 0.7 and expected[2] > 3.5 and tail[2] > 0.6 > 0.4 > tail[1]


def test_scores_of_long_and_repeated_texts(spark):
    data, labels = labelled(spark)
    clean = data.where("doc_id = 1").first().text
    odd = [(5000, clean + " " + "the fox jumps " * 30_000), (5001, "moronic " + "the fox jumps " * 30_000), (5001, "moronic " + "the fox jumps " * 30_000), (5002, "word" * 20_000)]
    more = spark.createDataFrame([(i, t, *(None,) * 6) for i, t in odd], data.schema)
    got = [r for r in toxicity.score(data.unionByName(more).repartition(3), labels).collect() if (r.doc_id or 0) >= 5000]
    by = collections.defaultdict(set)
    for r in got:
        by[r.doc_id].add(r.score)
    assert len(got) == 4 and all(len(s) == 1 for s in by.values()) and max(by[5001]) > max(by[5000])
    assert {r.tail_probability for r in quality.grade(more.where("doc_id = 5001"), labels).collect()}


def test_best_cut():
    odds, labels = np.array([3.0, 2.0, 2.0, 1.0, -1.0]), np.array([1, 1, 0, 1, 0])
    assert toxicity.best_cut(odds, labels) == 0.0  # three of four, against two of three
    assert toxicity.best_cut(np.array([1.0, 0.0]), np.array([1, 0])) == 0.5


def test_find_in_shards(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = spark.createDataFrame([(i, t) for i, t, *_ in rows()[:16]], "doc_id long, text string")
    shards, make = wavelet.write(docs, path, shard_tokens=300), tokens.Ids(path)
    own = {i: np.append(make([t or ""])[0], 2) for i, t, *_ in rows()[:16]}
    asked = [2, int(own[0][5]), int(own[12][7]), 50_000, 1 << 20]
    got = sorted((r.doc_id, r.token, r.at) for r in wavelet.find(shards, asked).collect())
    assert got == sorted((i, t, int(k)) for i, ids in own.items() for t in asked for k in np.flatnonzero(ids == t))
    x = np.random.default_rng(0).integers(0, 1 << 17, 5000).astype(np.uint32)
    m = wavelet.WaveletMatrix.build(x, 17)
    assert (m.access(np.arange(5000)) == x).all() and (m.ids() == x).all() and m.count(int(x[9]), 10) == int((x[10:] == x[9]).sum())
    empty = wavelet.WaveletMatrix.build(np.empty(0, np.uint32), 1)
    assert empty.count(1) == 0 and len(empty.ids()) == 0
    with pytest.raises(IndexError):
        m.access(5000)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_special_strings_are_text(name):
    """As the vocabularies' own notes load them; and a cache that holds next to nothing changes no id."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(name))
    library.encode_special_tokens = True
    make = tokens.Ids(public_tokenizers.path(name))
    texts = ["a <|endoftext|> b", "<|startoftext|>", "Straße ŒUVRE, Ñandú! привет. x1 1,000", "  ", "a" * 3000 + " b", None, "é́ x", "tab\there\nline  end "]
    for _ in range(2):
        ids, sizes = make(texts)
        ends = np.cumsum(sizes)
        assert [ids[e - n : e].tolist() for e, n in zip(ends, sizes)] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
        make.cache.most = 100


def test_loss_limits(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.createDataFrame([(i, prose(i, 3 + 17 * i % 90), 5 * i % 60 if i % 4 else None) for i in range(120)], "doc_id long, text string, mark long")
    limits = packing.Limits(tokens=256, segments=5, loss=100)
    got = packing.pack(docs.repartition(3), path, limits=limits, loss_from="mark").collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.sequence_id].append(r)
    for piece in by.values():
        assert len(piece) <= 5 and sum(r.length for r in piece) <= 256 and sum(r.loss_tokens for r in piece) <= 100
    marks = {r.doc_id: r.mark or 0 for r in docs.collect()}
    for d in marks:
        mine = sorted((r for r in got if r.doc_id == d), key=lambda r: r.start)
        assert sum(r.length for r in mine) == mine[0].doc_tokens and [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist()
        assert sum(r.loss_tokens for r in mine) == max(0, mine[0].doc_tokens - marks[d])


def test_pipeline_by_brute_force(spark, tmp_path):
    """Each stage, on what the stage before has kept, against the definition of what it is to do."""
    import corpus_pipeline

    data, labels = labelled(spark)
    r, shared = random.Random(9), prose(80, 70)
    extra = [(2000 + k, *row[1:]) for k, row in enumerate(rows())]
    for k in range(40):
        text = f"{prose(300 + k, r.randrange(5, 40))} {shared} {prose(400 + k, 30)}" if k % 3 else prose(500 + k // 6, 60) + (" more" if k % 2 else "")
        extra.append((3000 + k, text, *(None,) * 6))
    data.unionByName(spark.createDataFrame([(e[0], *e[1:]) for e in extra], data.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    kept = [spark.read.parquet(str(tmp_path / "documents.parquet"))]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, kept[-1], str(tmp_path)).write.parquet(str(tmp_path / name))
        kept.append(spark.read.parquet(str(tmp_path / name)))
    tables = [sorted(((x.doc_id, x.text or "") for x in k.collect()), key=lambda x: (x[0] is None, x[0] or 0, x[1])) for k in kept]

    good = {(x.doc_id): x.kept for x in quality.grade(kept[0], labels).collect()}
    assert tables[1] == [x for x in tables[0] if good[x[0]]]

    first = {}
    for i, t in tables[1]:
        key = re.sub("[\x20\x09-\x0d]+", " ", t)
        first.setdefault(key, (i, t))
    assert sorted(i if i is not None else -1 for i, _ in tables[2]) == sorted(i if i is not None else -1 for i, _ in first.values())

    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else ({tuple(w)} if w else set()) for i, w in ((i, words(t)) for i, t in tables[2] if i is not None)}
    best = {i: i for i in sets}
    for _ in range(5):
        for a in sets:
            for b in sets:
                if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    best[a] = best[b] = min(best[a], best[b])
    assert [x for x in tables[3]] == [x for x in tables[2] if x[0] is None or best[x[0]] == x[0]] and len(tables[3]) < len(tables[2])

    before, after = dict(x for x in tables[3] if x[0] is not None), dict(x for x in tables[4] if x[0] is not None)
    found, left = windows(before), collections.Counter()
    for t in after.values():
        w = words(t)
        left.update(tuple(w[k : k + 50]) for k in range(len(w) - 49))
    assert found and all(left[w] == 1 for w in found)
    touched = {d for places in found.values() for d, _ in places[1:]}
    assert all(after[d] == t for d, t in before.items() if d not in touched and t.strip())

    make = tokens.Ids(public_tokenizers.path("word_bpe_49k.json"))
    for row in corpus_pipeline.run(spark, str(tmp_path)).where("doc_id is not null").collect():
        ids = np.append(make([after[row.doc_id]])[0], 2).astype("<u4")
        assert row.doc_tokens == len(ids) and row.ids_crc32 == zlib.crc32(ids[row.start : row.start + row.length].tobytes())


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    data, labels = labelled(spark)
    data.where("1 = 0").write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_documents_held_out_of_both_classifiers(spark):
    """Labels of two thirds of the documents; accuracy on the others, and on misspelt words that no document had."""
    data, labels = labelled(spark)
    known = {r.doc_id: r for r in labels.where("doc_id < 600 and quality is not null").collect()}
    odd = [(7000, "the quick brown moroniic fox jumps over stone bridges"), (7001, "dimmwit wizards mix potions"), (7002, "quiet foxes jump over vivid stones")]
    more = data.unionByName(spark.createDataFrame([(i, t, *(None,) * 6) for i, t in odd], data.schema))
    toxic = {r.doc_id: r for r in toxicity.score(more, labels).collect()}
    held = [i for i in known if toxic[i].held_out]
    assert len(held) > 150 and sum(toxic[i].predicted == known[i].toxic for i in held) >= 0.97 * len(held)
    assert toxic[7002].predicted == 0 and min(toxic[7000].score, toxic[7001].score) > 10 * toxic[7002].score
    some = labels.where("doc_id % 3 != 0")
    kept = {r.doc_id: r.kept for r in quality.grade(data, some).collect()}
    unseen = [i for i in known if i % 3 == 0]
    assert sum(kept[i] == bool(known[i].quality) for i in unseen) >= 0.97 * len(unseen)


def test_rows_of_pieces_and_media(spark):
    import hashlib

    import sentencepiece

    from geoloom.llm import jpeg, pieces

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    docs = spark.createDataFrame([r[:2] for r in rows()], "doc_id long, text string").repartition(3)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.transcode(docs, path).collect()))
    want = []
    for d, t, *_ in rows():
        ids = model.encode(t or "", add_bos=True, add_eos=True)
        want.append((d if d is not None else -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(model.decode(ids).encode()).hexdigest()))
    assert got == sorted(want)
    none = docs.where("1 = 0")
    assert pieces.transcode(none, path).count() == jpeg.media(none).count() == packing.pack(none, public_tokenizers.path("word_bpe_49k.json")).count() == 0
    for r in jpeg.media(docs, with_media=True).collect():
        image = jpeg.Image(r.media)
        assert hashlib.sha256(r.media).hexdigest() == r.media_sha256 and jpeg.features(np.frombuffer(r.rgb, np.uint8).reshape(image.height, image.width, 3)) == r.feature
        assert (np.frombuffer(r.rgb, np.uint8) == image.rgb().ravel()).all() and hashlib.sha256(jpeg.restore(image)).hexdigest() == r.payload_sha256


def test_short_integers_as_ids(spark):
    """doc_id as a 32-bit integer gives what a 64-bit one gives."""
    from geoloom.llm import exact, jpeg, pieces

    path = public_tokenizers.path("word_bpe_49k.json")
    long = spark.createDataFrame([(i, t) for i, t, *_ in rows()[:12]], "doc_id long, text string")
    short = long.selectExpr("cast(doc_id as int) doc_id", "text")
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(8)], "doc_id int, quality int, toxic int")
    for op in (exact.dedup, lambda d: jaccard.classes(d, sketch_bits=16), substrings.repeats, jpeg.media, lambda d: packing.pack(d.coalesce(1), path), lambda d: pieces.transcode(d, public_tokenizers.path("piece_bpe_32k.model")), lambda d: wavelet.read(wavelet.write(d, path)), lambda d: toxicity.score(d, labels), lambda d: quality.grade(d, labels)):
        a, b = op(long), op(short)
        assert a.schema == b.schema and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
