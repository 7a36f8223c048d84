"""Chat, packing, pieces, media and archives: exact round trips and brute force."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from locusframe.llm import chat, mpeg_audio, packing, piece_wfst, warc, word_bpe
from locusframe.llm.words import Words


def test_words_and_hashes():
    texts = ["a b\tc", None, "", "  lead and trail \n", "é\x1fx y", "a", "x" * 5000 + " a"]
    w = Words(pa.array(texts))
    got = [[w.data[w.starts[j] : w.ends[j]].tobytes() for j in range(w.first[i], w.first[i + 1])] for i in range(len(texts))]
    assert got == [(x or "").encode().split() for x in texts]
    h, seen = w.hashes(step=100), {}
    for i, x in enumerate(x for t in got for x in t):
        assert seen.setdefault(x, h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


# --- chat


def test_chat_hostile(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "a\\b\\"), (2, None, None, None), (2, 1, "assistant", "<\\/s> \\\\[INST]"), (3, 1, "[/INST]", "\n"), (3, 1, "[/INST]", "\n"), (None, 5, "assistant", "")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.formatted(df).collect()}
    assert all(r["round_trip"] for r in got.values())
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "</s>[INST] ok [/INST]"), ("assistant", "a\\b\\")]
    assert [(t["role"], t["text"]) for t in got[2]["turns"]] == [("", ""), ("assistant", "<\\/s> \\\\[INST]")]
    assert len(got[3]["turns"]) == 2 and got[None]["turns"][0]["masked"] == 0
    for r in got.values():
        assert sum(t["before"] + t["masked"] + t["after"] for t in r["turns"]) == len(r["formatted"])
    empty = df.filter("false")
    assert chat.formatted(empty).collect() == [] and chat.digest(empty.drop("formatted")).count() == 1
    assert spark.createDataFrame([("x</s>",), ("<s>u[INST]a[INST]b[/INST]</s>",)], "f string").select(chat.parsed(chat.F.col("f")).alias("t")).filter("t is not null").count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<s>", "</s>", "[INST]", "[/INST]", "\\", "a", "é", "\n", "<", "]"]), max_size=8).map("".join), min_size=1, max_size=12))
def test_chat_round_trip(spark, texts):
    df = spark.createDataFrame([(i % 3, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string")
    out = chat.digest(df).collect()
    by = defaultdict(list)
    for i, t in enumerate(texts):
        by[i % 3].append((i, t))
    for r in out:
        if r["conv_id"] >= 0:
            assert r["round_trip"] and r["turns_sha256"] == hashlib.sha256("".join(f"{'assistant' if i % 2 else 'user'}\n{t}\n" for i, t in by[r["conv_id"]]).encode()).hexdigest()
            assert r["loss_sha256"] == hashlib.sha256("".join(t for i, t in by[r["conv_id"]] if i % 2).encode()).hexdigest()


# --- packing


def test_word_bpe_equals_library(docs001):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    texts = [r["text"] for r in docs001.select("text").limit(60).collect()]
    texts += [None, "", "İstanbul <|endoftext|>x don't I'LL ﬁ ΣΑΣ x²¾ 12,345", "naïve ÀÉ×÷ µ ª", "a\x1fb\xa0c　d", "é é <|", "日本語テキスト 🙂🙂"]
    rng = random.Random(4)
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 900), rng.randrange(0x4E00, 0x4F00)])) for _ in range(40)) for _ in range(200)]
    bpe = word_bpe.WordBpe(open(path, encoding="utf-8").read())
    assert bpe.fast is not None
    ids, first = bpe.texts(pa.array(texts, pa.string()), 2)
    whole = Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == [*whole.encode(t or "", add_special_tokens=False).ids, 2], t


def check_pieces(rows, ids, window=4096):
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"], r["doc_tokens"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for s in seqs.values():
        s.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in s] == [0, *np.cumsum([r["length"] for r in s])[:-1]]
        total = sum(r["length"] for r in s)
        assert total == window or total < window and total & (total - 1) == 0
    covered = 0
    for r in rows:
        assert r["length"] > 0
        assert any(zlib.crc32(x[r["start"] : r["start"] + r["length"]].astype("<u4").tobytes()) == r["ids_crc32"] for x in ids[r["doc_id"]])
        covered += r["length"]
    assert covered == sum(len(x) for v in ids.values() for x in v)
    return len(seqs)


def test_packing(spark, odd, docs001):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    for df in (odd[0], docs001):
        ids = defaultdict(list)
        for r in df.select("doc_id", "text").collect():
            ids[r["doc_id"]].append(np.array([*whole.encode(r["text"] or "", add_special_tokens=False).ids, 2]))
        for shard in (1 << 23, 30000):
            rows = packing.pack_documents(df, packing.tokenizer_path(), shard_tokens=shard).collect()
            check_pieces(rows, ids)
    assert packing.digest(odd[0].filter("false")).collect() == []


def test_index_finds_neighbours():
    rng = np.random.default_rng(5)
    topics = [rng.integers(k * 100, k * 100 + 100, 400) for k in range(5)]
    docs = [rng.choice(topics[i % 5], 60) for i in range(50)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=500)
    index = packing.Index(docs, np.log1p((50 - df + 0.5) / (df + 0.5)), 60.0, 24)
    index.alive[0] = 0
    near = index.neighbours(0, 9)
    assert set(near.tolist()) == set(range(5, 50, 5))


def test_neighbours_come_from_all_shards(spark):
    rng = np.random.default_rng(6)
    docs = [rng.zipf(1.3, rng.integers(20, 90)) % 900 for _ in range(150)]
    docs += [docs[i] for i in range(40)]  # copies under other ids
    rows = [(i, len(d), bytearray(d.astype("<u2").tobytes())) for i, d in enumerate(docs)]
    tokens = spark.createDataFrame(rows, "doc_id long, n_tokens int, ids binary")
    df, n, total = packing.statistics(tokens, 2)
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), total / n
    search = packing.Search(packing.indexed(tokens, 2, 7, 256), idf, mean, 2, 256, 12)
    names = [x for r in search.index.orderBy("shard").collect() for x in np.frombuffer(r["names"], np.int64).tolist()]
    assert len(search.shards) == 7 and sorted(names) == list(range(190))
    used = np.zeros(190, bool)
    used[::9] = True
    found = search.documents(list(range(190)))
    near = search.neighbours([found[g][1] for g in range(190)], used)
    for g in range(190):
        score = np.zeros(190)
        for j, name in enumerate(names):
            t, c = np.unique(docs[name], return_counts=True)
            score[j] = 0 if used[j] else (idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[name]) / mean)) * np.isin(t, docs[names[g]])).sum()
        assert np.allclose([score[j] for j, _ in near[g]], np.sort(score)[::-1][:12][: len(near[g])], rtol=1e-4)
        assert len(near[g]) == min(12, (score > 0).sum()) and all(k == len(docs[names[j]]) for j, k in near[g])


def test_copies_in_other_shards_are_packed_together(spark):
    rng = np.random.default_rng(7)
    topics = [rng.integers(k * 100, k * 100 + 100, 100) for k in range(8)]
    rows = [(i, 60, bytearray(rng.choice(topics[i % 8], 60).astype("<u2").tobytes())) for i in range(400)]
    tokens = packing.store.written(spark.createDataFrame(rows, "doc_id long, n_tokens int, ids binary"), "tokens")
    seqs = defaultdict(list)
    for r in packing.packed(tokens, window=512, shard_tokens=3000).collect():
        seqs[r["sequence_id"]].append(r["doc_id"] % 8)
    full = [v for v in seqs.values() if len(v) > 4]
    assert sum(max(map(v.count, v)) for v in full) >= 0.85 * sum(map(len, full))


def test_all_terms_of_a_query_count():
    own = [np.arange(1000 + 40 * i, 1040 + 40 * i) for i in range(20)]  # 40 ids that no other document has
    docs = [np.concatenate([own[i], np.arange(i % 4 * 50, i % 4 * 50 + 50)]) for i in range(20)]
    df = np.bincount(np.concatenate(docs), minlength=2000)
    index = packing.Index(docs, np.log1p((20 - df + 0.5) / (df + 0.5)), 90.0, 24)
    index.alive[0] = 0
    assert set(index.neighbours(0, 4).tolist()) == {4, 8, 12, 16}


def hubs(n, seed):
    """Documents of two vocabularies, of which the longest are everyone's neighbours."""
    rng = np.random.default_rng(seed)
    return [(rng.zipf(1.3, int(rng.integers(5, 120))) % 300 + 300 * (i % 2)).astype("<u2") for i in range(n)]


def token_table(spark, docs):
    return spark.createDataFrame([(i, len(d), bytearray(d.tobytes())) for i, d in enumerate(docs)], "doc_id long, n_tokens int, ids binary")


def test_windows_ask_about_once(spark):
    docs, asked = hubs(1200, 8), []

    class Counted(packing.Search):
        def neighbours(self, queries, used):
            asked.append(len(queries))
            return super().neighbours(queries, used)

    tokens = token_table(spark, docs)
    df, n, total = packing.statistics(tokens, 2)
    index = packing.indexed(tokens, 2, 9, 512)
    for last, times in ((40, 1.1), (0, 1.4)):  # with and without the driver's windows at the end; with lists of 9 alone 1.7 times
        asked.clear()
        search = Counted(index, np.log1p((n - df + 0.5) / (df + 0.5)), total / n, 2, 512, 9, 256)
        seqs = list(packing.fill(search, 512, 32, last))
        placed = sorted((g, start, k) for q in seqs for g, start, k in q)
        assert sum(k for _, _, k in placed) == total and all(a[0] != b[0] or a[1] + a[2] == b[1] for a, b in zip(placed, placed[1:], strict=False))
        assert len({g for g, _, _ in placed}) == n and sum(sum(k for _, _, k in q) < 512 for q in seqs) <= 9
        assert 0 < sum(asked) <= times * len(seqs)


def test_lists_beyond_k_are_exact(spark):
    docs = hubs(300, 9)
    tokens = token_table(spark, docs)
    df, n, total = packing.statistics(tokens, 2)
    idf, mean = np.log1p((n - df + 0.5) / (df + 0.5)), total / n
    search = packing.Search(packing.indexed(tokens, 2, 7, 256), idf, mean, 2, 256, 6, 60)
    names = [x for r in search.index.orderBy("shard").collect() for x in np.frombuffer(r["names"], np.int64).tolist()]
    used = np.zeros(300, bool)
    used[::7] = True
    found = search.documents(list(range(300)))
    near = search.neighbours([found[g][1] for g in range(300)], used)
    rest = search.rest(used, set(), 300).neighbours([found[g][1] for g in range(300)], used)
    for g in range(300):
        t, c = np.unique(docs[names[g]], return_counts=True)
        assert found[g][0] == len(docs[names[g]]) and found[g][1].tolist() == t.tolist() and found[g][2].tolist() == c.tolist()
        score = np.zeros(300)
        for j, name in enumerate(names):
            t, c = np.unique(docs[name], return_counts=True)
            score[j] = 0 if used[j] else (idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(docs[name]) / mean)) * np.isin(t, found[g][1])).sum()
        most = np.sort(score[score > 0])[::-1]
        assert min(6, len(most)) <= len(near[g]) <= 60 and np.allclose([score[j] for j, _ in near[g]], most[: len(near[g])], rtol=1e-4)
        assert np.allclose([score[j] for j, _ in rest[g]], most[:6], rtol=1e-4)
    assert np.mean([len(x) for x in near]) > 12


def test_index_of_many_short_documents_is_bounded():
    rng = np.random.default_rng(10)
    docs = [rng.integers(0, 100, 30) for _ in range(90_000)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=100)
    idf = np.log1p((len(docs) - df + 0.5) / (df + 0.5))
    index = packing.Index(docs, idf, 30.0)
    assert index.matrix.nbytes <= 32 << 20
    queries = [np.unique(docs[i]) for i in range(100)]
    for q, (top, score) in zip(queries[:5], index.best(queries, 9), strict=False):
        exact = np.zeros(len(docs))
        for x in q:
            a, z = index.first[x], index.first[x + 1]
            exact[index.doc[a:z]] += index.weight[a:z]
        assert np.allclose(score, np.sort(exact)[::-1][:9], rtol=1e-4) and np.allclose(exact[top], score, rtol=1e-4)


def test_worker_drops_tokenizers():
    from locusframe.llm import worker

    word_bpe._loaded(open(packing.tokenizer_path(), encoding="utf-8").read())
    worker.lean()
    assert word_bpe._loaded.cache_info().currsize == 0


# --- pieces


def test_pieces_equal_library(docs001):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_wfst.model_path())
    fst = piece_wfst.Transducer(open(piece_wfst.model_path(), "rb").read())
    texts = [r["text"] for r in docs001.select("text").limit(80).collect()] + [None, "", " ", "  a  ", "a" * 300, "\n\n", "日本🙂", "▁x", "<s> </s> <0x41>"]
    rng = random.Random(2)
    texts += ["".join(rng.choice(["the", " ", "ing", "\n", ",", "é", "0", "00", "tion", "A", "日", "-", "  "]) for _ in range(30)) for _ in range(400)]
    texts += [(fst.pieces[rng.randrange(259, 32000)] + fst.pieces[rng.randrange(259, 32000)]).replace("▁", " ") for _ in range(600)]
    ids, first = fst.texts(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        own = ids[first[i] : first[i + 1]]
        assert own.tolist() == sp.encode(t or ""), t
        assert fst.text(own) == sp.decode(own.tolist())


def test_pieces_query(spark, odd):
    got = piece_wfst.digest(odd[0]).collect()
    assert len(got) == len(odd[1]) and all(r["round_trip"] for r in got)
    assert piece_wfst.digest(odd[0].filter("false")).collect() == []


def test_unigram_shortest_path():
    def msg(n, b):
        return bytes([n << 3 | 2, len(b)]) + b

    def piece(s, score, kind=1):
        return msg(1, msg(1, s.encode()) + bytes([2 << 3 | 5]) + np.float32(score).tobytes() + bytes([3 << 3, kind]))

    model = piece("<unk>", 0, 2) + b"".join(piece(s, v) for s, v in (("▁", -3), ("a", -2), ("b", -2), ("ab", -3.5), ("▁a", -4.5), ("▁ab", -9)))
    model += msg(2, bytes([3 << 3, 1])) + msg(3, bytes([3 << 3, 1, 4 << 3, 0, 5 << 3, 1]))
    fst = piece_wfst.Transducer(model)
    assert [fst.pieces[i] for i in fst.path("▁ab")] == ["▁", "ab"] or sum(-fst.scores[i] for i in fst.path("▁ab")) == 6.5
    assert [fst.pieces[i] for i in fst.path("▁xb")] == ["▁", "<unk>", "b"]


# --- media


def test_media_round_trip():
    rng = random.Random(6)
    for n in (0, 1, 64, 936, 937, 938, 5000, 937 * 3):
        payload = rng.randbytes(n)
        data = mpeg_audio.pack(payload)
        found = mpeg_audio.probe(data)
        assert mpeg_audio.unpack(data) == payload
        assert found["junk_bytes"] == 0 and found["bad_checksums"] == 0 and found["table"]["frames"] == len(found["audio"]) and found["table"]["tag_crc_ok"]
        assert found["duration_num"] * 48000 == found["duration_den"] * 1152 * len(found["audio"])


def test_media_resynchronises_and_verifies():
    data = mpeg_audio.pack(b"\xff\xfb\x90\x00" * 900)
    clean = mpeg_audio.probe(data)
    noisy = mpeg_audio.probe(b"\xff\xfa\x00" * 7 + data[:-500] + data[-500:] + b"\xff\xff" + b"TAG" + b"t".ljust(125, b"\0"))
    assert [b - a for (a, _), (b, _) in zip(clean["audio"], noisy["audio"], strict=True)] == [21] * len(clean["audio"])
    assert noisy["junk_bytes"] == 23 and noisy["tags"]["id3v1_title"] == "t"
    at = clean["audio"][1][0]
    broken = data[: at + 10] + b"\x55" + data[at + 11 :]
    assert mpeg_audio.probe(broken)["bad_checksums"] == 1
    with pytest.raises(ValueError, match="damaged"):
        mpeg_audio.unpack(broken)
    assert mpeg_audio.probe(b"nothing here")["audio"] == [] and mpeg_audio.probe(b"")["duration_num"] == 0
    # a frame of each kind: MPEG-1 layer I 384 kbit/s 44.1 kHz, layer II 128 kbit/s 48 kHz, MPEG-2 layer III 64 kbit/s 24 kHz
    assert mpeg_audio.header(b"\xff\xff\xc0\x00")[:3] == (416, 384, 44100)
    assert mpeg_audio.header(b"\xff\xfd\x84\x00")[:3] == (384, 1152, 48000)
    assert mpeg_audio.header(b"\xff\xf3\x84\x00")[:3] == (192, 576, 24000)
    assert mpeg_audio.header(b"\xff\xe9\x84\x00") is None and mpeg_audio.header(b"\xff\xfb\xf0\x00") is None


def test_media_query(spark, odd):
    df, rows = odd
    for r in mpeg_audio.digest(df).collect():
        texts = [(t or "").encode() for d, t, _ in rows if d == r["doc_id"]]
        b = texts[0]
        p = b.ljust(max(64, -(-len(b) // 64) * 64), b"\0")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    out = mpeg_audio.with_features(mpeg_audio.with_media(df), keep_media=True)
    assert out.count() == len(rows) and "lang" in out.columns
    nulls = mpeg_audio.with_features(spark.createDataFrame([(1, None), (2, b"junk")], "id long, media binary")).orderBy("id").collect()
    assert nulls[0]["n_frames"] is None and nulls[1]["n_frames"] == 0 and nulls[1]["payload"] is None
    assert mpeg_audio.digest(df.filter("false")).collect() == []


# --- archives


def test_warc(spark):
    rows = [(1, "u", "a"), (1, "u", "a"), (2, "v", "a"), (None, "w", "a"), (3, None, None), (4, "x\r\ny", ""), (5, "z", "WARC/1.1\r\n\r\nWARC/1.0"), (6, "é\x01", "é" * 40000)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "page_id long, url string, html string, type string")
    got = sorted(((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.digest(df).collect()), key=str)
    want = [(1, 1, "revisit", 2), (1, 1, "revisit", 2), (2, 1, "response", None), (3, 0, "revisit", 4), (4, 0, "response", None), (5, 20, "response", None), (6, 80000, "response", None), (None, 1, "revisit", 2)]
    assert got == sorted(want, key=str)
    assert warc.digest(df.filter("false")).collect() == []


def test_warc_reads_other_archives():
    import gzip

    def record(kind, rid, block, *more):
        return ("WARC/1.0\r\n" + "\r\n".join([f"WARC-Type: {kind}", f"WARC-Record-ID: {rid}", *more, f"Content-Length: {len(block)}"]) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    parts = [record("warcinfo", "<i>", b"x"), record("response", "<r>", b"HTTP/1.1 200 OK\r\nA: b\r\n\r\nbody", "WARC-Target-URI: http://a", " folded"), b"garbage\r\n", record("metadata", "<m>", b"k: v\r\n", "WARC-Concurrent-To: <r>")]
    for data in (b"".join(parts), b"".join(gzip.compress(p) for p in parts), gzip.compress(b"".join(parts))):
        got = list(warc.records(warc.inflated(data)))
        assert [(r[0], r[1]) for r in got] == [("<i>", "warcinfo"), ("<r>", "response"), ("<m>", "metadata")]
        assert got[1][-1] == b"body" and got[1][2] == "http://a folded" and got[2][9] == {"k": "v"} and got[2][4] == "<r>"
