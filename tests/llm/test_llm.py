"""Text operators against brute force, libraries and exact round trips, with the awkward cases in every table."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from geoloom.llm import chat, exact, jaccard, jpeg, packing, pieces, quality, substrings, tokens, toxicity, wavelet
from geoloom.llm.components import components

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, uid int, ranges int"
WORDS = "the quick brown fox jumps over a lazy dog while seven small wizards quietly mix vivid potions beneath old stone bridges".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(40)) for _ in range(n))


def rows():
    base, shared = prose(1, 120), prose(2, 70)
    near = base.split()
    near[60] = "changed"
    texts = [base, base, base.replace(" ", " \n", 3), " ".join(near), None, "", "  \t ", "one", "one two", "one two three four five", prose(3, 40) + " " + shared + " " + prose(4, 40), shared + " " + prose(5, 90), prose(6, 9000), "a" * 5000, "Ünïcode ﬁ 日本 😀 " + prose(7, 20), "</s>[INST] <|endoftext|> \\ x  y"]
    out = [(i, t, "en", "s", len(t or ""), "clash", 1, 2) for i, t in enumerate(texts)]
    return out + [out[3]] + [(None, base, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def test_exact(docs, none):
    texts = collections.defaultdict(list)
    for d, t, *_ in rows():
        texts[re.sub("[\x20\x09-\x0d]+", " ", t or "")].append(d)
    for block in (1 << 14, 16):
        got = exact.dedup(docs, block=block).collect()
        assert len(got) == len(rows())
        for t, ids in texts.items():
            mine = [r for r in got if r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()]
            assert {r.keep_id for r in mine} == {min(i for i in ids if i is not None)} and {r.group_size for r in mine} == {len(ids)}
            assert sum(r.kept for r in mine) == 1
    assert exact.keep(docs).count() == len(texts) and exact.keep(docs).columns == docs.columns
    assert exact.dedup(none).count() == 0


def test_jaccard(docs, none):
    sets = {}
    for d, t, *_ in rows():
        w = words(t)
        if d is not None:
            sets[d] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    best = {d: min(e for e in sets if e == d or (sets[d] and 100 * len(sets[d] & sets[e]) >= 75 * len(sets[d] | sets[e]))) for d in sets}
    got = jaccard.classes(docs, sketch_bits=16).collect()
    assert len(got) == len(rows())
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == {d: (len(s), best[d]) for d, s in sets.items()}
    assert {r.component_id for r in got if r.doc_id is None} == {None}
    assert jaccard.classes(none, sketch_bits=16).count() == 0


def test_jaccard_of_a_repeated_doc_id(spark):
    """Sets are read back by doc_id: two texts of one are not taken for each other."""
    pairs = [(i, prose(400 + i, 60)) for i in range(20)]
    texts = pairs + [(i, prose(500 + i, 60)) for i in range(20)] + [(100 + i, t + " more") for i, t in pairs] + [(200 + i, prose(500 + i, 60) + " more") for i in range(20)]
    got = jaccard.classes(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), sketch_bits=16).collect()
    assert len(got) == 80 and all(r.component_id == r.doc_id % 100 for r in got)


def test_jaccard_runs_cross_batches():
    import pyarrow as pa

    token = np.repeat([5, 7, 9], [4, 1, 3])
    cols = [token, np.arange(8), np.full(8, 40), np.zeros(8, int)]

    def batches(size):
        for k in range(0, 8, size):
            yield pa.RecordBatch.from_arrays([pa.array(c[k : k + size]) for c in cols], ["token", "name", "n", "at"])

    found = [[tuple(r.values()) for b in jaccard._propose(75)(batches(s)) for r in b.to_pylist()] for s in (1, 2, 3, 8)]
    assert all(sorted(f, key=str) == sorted(found[-1], key=str) for f in found) and len(found[-1]) == 7


def test_suffix_filter_is_a_lower_bound():
    r = np.random.default_rng(0)
    for _ in range(200):
        x, y = (np.unique(r.integers(0, 60, r.integers(0, 40)).astype(np.uint64)) for _ in "xy")
        assert jaccard.hamming_bound(x, y) <= len(np.setxor1d(x, y))


def test_components_of_a_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 40), (40, 40), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(31)}, 40: 40, 50: 40}


def test_substrings(docs, none):
    seen, text = collections.defaultdict(set), {}
    for d, t, *_ in rows():
        if d is not None:
            text[d] = w = words(t)
            for i in range(len(w) - 49):
                seen[tuple(w[i : i + 50])].add((d, i))
    want = {d: set() for d in text}
    for at in seen.values():
        if len(at) > 1:
            for d, i in at:
                want[d].update(range(i, i + 50))
    got = {d: set() for d in text}
    for r in substrings.repeats(docs).collect():
        got[r.doc_id].update(range(r.start_word, r.start_word + r.n_words))
    assert got == want and any(want.values())
    cut = {r.doc_id: r for r in substrings.cut(docs).collect()}
    assert 1 not in cut and cut[0].text == rows()[0][1] and cut[11].n_chars == len(cut[11].text)
    assert substrings.repeats(none).count() == substrings.cut(none).count() == 0
    assert substrings.without("a b  c d", [(1, 2)]) == "a  d"


def windows(texts):
    """Places (doc_id, first word) of every 50-word window that has several."""
    at = collections.defaultdict(list)
    for d, t in sorted(texts.items()):
        w = words(t)
        for i in range(len(w) - 49):
            at[tuple(w[i : i + 50])].append((d, i))
    return {w: x for w, x in at.items() if len(x) > 1}


def test_substrings_of_templates(spark):
    """One block, many documents that agree on either side or both: every repeated window counts, and its first is kept."""
    r, shared = random.Random(5), prose(30, 44)
    texts = {d: f"{prose(100 + r.randrange(12), 4)} {shared} {prose(200 + r.randrange(12), 4)}" for d in range(300)}
    want, got = ({k: collections.defaultdict(set) for k in (True, False)} for _ in range(2))
    for places in windows(texts).values():
        for k, (d, i) in enumerate(places):
            want[k == 0][d].update(range(i, i + 50))
    for x in substrings.repeats(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect():
        got[x.kept][x.doc_id].update(range(x.start_word, x.start_word + x.n_words))
    assert got == want and sum(map(len, want[False].values())) > 8000


def test_cut_keeps_every_window(spark):
    """The first document with a block quotes less than a window, or has an edit; passages follow on from others."""
    texts, near = {}, prose(301, 100).split()
    near[30] = "changed"
    for k, head in enumerate((" ".join(prose(300, 100).split()[20:62]), " ".join(near))):
        texts |= {10 * k: head} | {10 * k + j: f"{prose(310 + 10 * k + j, 20)} {prose(300 + k, 100)} {prose(330 + 10 * k + j, 20)}" for j in range(1, 5)}
    a, b, c = (prose(k, 100) for k in (350, 351, 352))
    texts |= {20: a, 21: f"{a} {b}", 22: f"{a} {b}", 23: f"{c} {b}", 24: f"{c} {b} {a}", 25: prose(353, 1) + " again" * 200}
    found = windows(texts)
    cut = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    left = collections.defaultdict(set)
    for d, t in substrings.cut(cut).collect():
        w = words(t)
        for i in range(len(w) - 49):
            left[tuple(w[i : i + 50])].add((d, i))
    assert len(found) > 200 and {len(left[w]) for w in found} == {1}
    assert substrings.unkept([dict(start_word=s, n_words=n, kept=k) for s, n, k in ((0, 60, False), (10, 50, True), (80, 90, False), (90, 50, True))]) == [(0, 10), (80, 10), (140, 30)]



@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens_are_the_librarys(name):
    make = tokens.Ids(public_tokenizers.path(name))
    r = random.Random(3)
    texts = [t or "" for _, t, *_ in rows()] + ["".join(r.choice("ab .,'\n\t é\u0301ΣİＡ1\x1c\u00a0") for _ in range(30)) for _ in range(300)]
    for _ in range(2):
        ids, lengths = make(texts)
        ends = np.cumsum(lengths)
        for t, a, b in zip(texts, ends - lengths, ends):
            assert ids[a:b].tolist() == make.library.encode(t, add_special_tokens=False).ids, t
    make.cache.most = 5
    assert make(texts)[0].tolist() == ids.tolist() == make(texts)[0].tolist()


def test_pieces_are_the_librarys(docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, codec = sentencepiece.SentencePieceProcessor(model_file=path), pieces.Codec(pieces.Vocabulary.load(path))
    r = random.Random(4)
    texts = [t or "" for _, t, *_ in rows()] + ["".join(r.choice("abtheing  \n▁é梦😀") for _ in range(40)) for _ in range(500)]
    ids, lengths = codec.encode(texts)
    ends = np.cumsum(lengths)
    for t, a, b, d in zip(texts, ends - lengths, ends, codec.decode(ids, lengths)):
        want = model.encode(t, add_bos=True, add_eos=True)
        assert ids[a:b].tolist() == want and d.decode() == model.decode(want), t
    assert pieces.transcode(docs, path).count() == len(rows())


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    got = packing.pack(docs, path, with_ids=True).collect()
    fill, by = collections.Counter(), collections.defaultdict(list)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id] and r.length > 0 and zlib.crc32(r.ids) == r.ids_crc32
        fill[r.sequence_id] += r.length
        by[r.doc_id].append(r)
    assert max(fill.values()) <= 4096 and all(n == 4096 or n & (n - 1) == 0 for n in fill.values())
    make = tokens.Ids(path)
    for d, t, *_ in rows():
        if d != 3:  # two rows have this doc_id
            ids = b"".join(r.ids for r in sorted(by[d], key=lambda r: r.start))
            assert np.frombuffer(ids, "<u4").tolist() == make([t or ""])[0].tolist() + [2] and {r.doc_tokens for r in by[d]} == {len(ids) // 4}
    assert packing.pack(none, path).count() == 0
    packer = packing.Packer(packing.Limits(64, 3, 20), 4)
    for k in range(200):
        packer.add(k, 0, 1 + k % 40, k % 7)
    packer.finish()
    placed = collections.Counter()
    for items in packer.take():
        assert len(items) <= 3 and sum(b - a for _, a, b, _ in items) <= 64 and sum(max(0, b - max(a, f)) for _, a, b, f in items) <= 20
        for k, a, b, _ in items:
            placed[k] += b - a
    assert placed == {k: 1 + k % 40 for k in range(200)}


def test_wavelet(docs, none):
    path = public_tokenizers.path("byte_bpe_50k.json")
    make, start = tokens.Ids(path), 0
    got = sorted(wavelet.read(wavelet.write(docs, path, shard_tokens=300)).collect(), key=lambda r: r.start)
    want = sorted(((d if d is not None else -1, t or "") for d, t, *_ in rows()))
    for r, (d, t) in zip(got, want):
        ids = np.append(make([t])[0], 2).astype("<u4")
        assert (r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(want) and wavelet.read(wavelet.write(none, path)).count() == 0
    x = np.random.default_rng(0).integers(0, 300, 2000).astype(np.uint32)
    m = wavelet.load(wavelet.dump(x, np.array([2000]), [1]))[0]
    assert m.ids().tolist() == x.tolist() and [m.access(i) for i in range(0, 2000, 97)] == x[::97].tolist()
    at = np.flatnonzero(x == x[5])
    assert m.count(int(x[5])) == len(at) and [m.select(int(x[5]), k) for k in range(len(at))] == at.tolist()


def test_jpeg(docs, monkeypatch):
    raw = [(t or "").encode() for _, t, *_ in rows()] + [bytes(range(256)) * 3]
    files = jpeg.store([jpeg.padded(r) for r in raw])
    images = [jpeg.Image(f) for f in files]
    assert [jpeg.restore(i) for i in images] == [jpeg.padded(r) for r in raw]
    whole = jpeg.tensors(images)
    monkeypatch.setattr(jpeg.Image, "_whole", lambda *a: False)  # bit by bit
    for f, image, tensor in list(zip(files, images, whole))[:6]:
        slow = jpeg.Image(f)
        assert jpeg.restore(slow) == jpeg.restore(image) and (slow.rgb() == tensor).all()
    got = {r.doc_id: r for r in jpeg.media(docs).collect() if r.doc_id is not None}
    assert got[0].media_sha256 == got[1].media_sha256 and got[4].payload_bytes == 192
    for d, t, *_ in rows():
        if d is not None:
            p = jpeg.padded((t or "").encode())
            assert (got[d].payload_sha256, got[d].tail_crc32) == (hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))


def test_inverse_transform_of_one_wave():
    c = np.zeros((1, 64), np.int64)
    c[0, 0], c[0, 2] = 80, 40
    u = np.array([[0.125**0.5 * 80 * 0.125**0.5 + 40 * 0.5 * np.cos((2 * y + 1) * np.pi / 16) * 0.125**0.5 for _ in range(8)] for y in range(8)])
    assert (abs(jpeg.inverse_transform(c)[0].reshape(8, 8) - (u + 128)) <= 1).all()


def test_chat(spark):
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\</s>", "[TURN]x[/TURN]\\", None, "", "a\nb", "<", "[INST"]
    conv = [(1, k, r, t) for k, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "system"))] + [(None, 0, None, "x"), (2, None, "user", "y")]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(conv, "conv_id long, turn long, role string, text string"))).collect()}
    said = "".join(t or "" for c, _, r, t in conv if c == 1 and r == "assistant")
    whole = "".join(f"{r}\n{t or ''}\n" for c, _, r, t in conv if c == 1)
    assert got[1].n_turns == 27 and got[1].turns_sha256 == hashlib.sha256(whole.encode()).hexdigest()
    assert (got[1].loss_chars, got[1].loss_sha256) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    assert set(got) == {1, 2, None}
    layouts = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a","x":1}]}', '{"instruction":"q","input":"","output":"a"}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"prompt":"q","completion":"a"}', '{"zzz":1}', "no json", None]
    out = chat.format_records(spark.createDataFrame([(s,) for s in layouts], "record string")).collect()
    assert [chat.parsed(r.output) for r in out if r.output is not None] == [("user", "q"), ("assistant", "a")] * 4
    assert sum(r.layout is None for r in out) == 3


def labelled(spark):
    r = random.Random(5)
    data, marks = [], []
    for i in range(600):
        ws = [r.choice(WORDS) for _ in range(r.randint(5, 120))]
        if toxic := i % 4 == 0:
            for _ in range(3):
                ws.insert(r.randrange(len(ws)), r.choice(["moronic", "imbecile", "dimwit"]))
        if poor := i % 5 == 1:
            ws = [w.upper() + "!!" for w in ws]
        data.append((i, " ".join(ws), *(None,) * 6))
        marks.append((i, int(not poor), int(toxic)))
    data += [(900, None, *(None,) * 6), (901, "", *(None,) * 6), (902, "you moroniic fellow", *(None,) * 6), (None, "x", *(None,) * 6)]
    return spark.createDataFrame(data, SCHEMA), spark.createDataFrame(marks + [(5, None, None)], "doc_id long, quality int, toxic int")


def test_toxicity(spark, none):
    data, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.score(data, labels).collect()}
    held = [r for i, r in got.items() if i is not None and i < 600 and r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items() if i is not None)
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert got[902].score > got[901].score == got[900].score and all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(none, labels).count() == 0
    assert {r.predicted for r in toxicity.score(data, labels.where("1 = 0")).collect()} == {0}


def test_quality(spark, none):
    data, labels = labelled(spark)
    got = quality.grade(data, labels)
    known = [r for r in got.collect() if r.doc_id is not None and r.doc_id < 600]
    assert sum(r.kept == (r.doc_id % 5 != 1) for r in known) >= 0.97 * len(known)
    assert quality.keep(data, labels).columns == data.columns and quality.keep(data, labels).count() == got.where("kept").count()
    assert quality.grade(none, labels).count() == 0 and quality.grade(data, labels.where("1 = 0")).where("not kept").count() == 0
    x = np.random.default_rng(0).random((300, 1))
    y = np.digitize(x[:, 0], [0.3, 0.7])
    model = quality.train([(np.array([7]), np.array([v[0]], np.float32)) for v in x], y.astype(float))
    assert len(model.thresholds) == 2 and model.thresholds[0] < model.thresholds[1]


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    data, labels = labelled(spark)
    data.unionByName(spark.createDataFrame([(1000 + r[0], *r[1:]) for r in rows() if r[0] is not None], SCHEMA)).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns, sizes = at.columns, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, at, str(tmp_path)).write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
        assert at.columns == columns
        sizes.append(at.count())
    assert sizes == sorted(sizes, reverse=True) and len(set(sizes)) >= 3
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().count() == sizes[-1]
