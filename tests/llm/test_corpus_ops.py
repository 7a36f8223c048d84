"""Near duplicates, passages, classifiers, rules and the pipeline against brute force and held-out rows."""

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from locusframe.llm import language_id, near_dedup, quality_classifier, quality_rules, substring_dedup

WORD = r"[^\x20\x09-\x0D]+"


def shingles(text, n):
    w = re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_components(rows, n):
    sets, up = [shingles(t, n) for _, t in rows], list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        both = len(sets[i] & sets[j])
        if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            up[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[top(i)] = min(d, least.get(top(i), d))
    return [(d, len(sets[i]), least.get(top(i)), d == least.get(top(i))) for i, (d, _) in enumerate(rows)]


def family_rows():
    """Groups of near copies, two of them close to each other without a link between most."""
    rng, words, rows, base = random.Random(5), [f"w{i}" for i in range(4000)], [], None
    for fam in range(3):
        base = [rng.choice(words) for _ in range(120)] if fam != 1 else [rng.choice(words) if k % 13 == 0 else x for k, x in enumerate(base)]
        for _ in range(60):
            w = list(base)
            for _ in range(rng.choice([1, 4, 6, 8, 10])):
                w[rng.randrange(120)] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, "one"), (1003, "ONE"), (None, "one"), (1004, "a b"), (1004, "c d e")]


@pytest.mark.parametrize("block", [1024, 32])
def test_near_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    rows = family_rows()
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, node long")
    got = [tuple(r) for r in near_dedup.components_of(df, shingle=2).collect()]
    assert sorted(got, key=str) == sorted(brute_components(rows, 2), key=str)


def test_near_dedup_odd(spark, odd):
    df, rows = odd
    got = [tuple(r) for r in near_dedup.components_of(df, shingle=2).collect()]
    assert sorted(got, key=str) == sorted(brute_components([r[:2] for r in rows], 2), key=str)
    kept = near_dedup.deduplicated(df)
    assert kept.columns == df.columns and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, None, 6, 8, 9], key=str)
    assert near_dedup.components_of(df.filter("false")).collect() == []


def test_one_row_of_a_component_stays(spark, prose):
    a, b, c = (prose(200, 900 + i) for i in range(3))
    near = lambda t: t + " tail"
    rows = [(1, a), (None, near(a)), (None, b), (None, near(b)), (5, b + " other"), (7, c), (7, near(a)), (8, near(c)), (None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = [tuple(r) for r in near_dedup.deduplicated(df).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (5, b + " other"), (7, c), (None, None), (None, "")], key=str)


def test_bitmaps_bound_overlap():
    rng = np.random.default_rng(1)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(20, 300))) for _ in "ab")
        x, y = (np.frombuffer(near_dedup.bitmap(s), np.uint64) for s in (a, b))
        size = min(len(x), len(y))
        fold = lambda m: np.bitwise_or.reduce(m.reshape(-1, size), axis=0)  # noqa: B023, E731
        x, y, both = fold(x), fold(y), len(np.intersect1d(a, b))
        ok = near_dedup._within(x[None], y[None], np.array([len(a)]), np.array([len(b)]), np.array([[True]]), 80)[0, 0]
        assert ok or 100 * both < 80 * (len(a) + len(b) - both)


def brute_removed(rows, n=13):
    words = [re.findall(WORD, t or "") for _, t in rows]
    least = {}
    for (d, _), w in zip(rows, words, strict=True):
        for i in range(len(w) - n + 1):
            k = tuple(w[i : i + n])
            least[k] = min(d if d is not None else 1 << 62, least.get(k, 1 << 62))
    out = []
    for (d, _), w in zip(rows, words, strict=True):
        gone = set()
        for i in range(len(w) - n + 1):
            if least[tuple(w[i : i + n])] < (d if d is not None else 1 << 62):
                gone |= set(range(i, i + n))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((d, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("capacity", [1 << 21, 300])
def test_substring_dedup(spark, odd, prose, capacity):
    df, rows = odd
    for seed in range(4):
        rows = rows + [(20 + seed, prose(30, 50 + seed) + "\n\n " + prose(60, 99) + " " + prose(10, seed), "en")]
    rows = rows + [(40, "x " * 300, "en"), (41, "x " * 20, "en"), (42, "y " + "x " * 13, "en"), (43, "x " * 12, "en")]
    df = spark.createDataFrame([(*r, i, "x", 0.5) for i, r in enumerate(rows)], df.schema)
    out = substring_dedup.deduplicated(df, capacity=capacity)
    got = [(r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in out.collect()]
    assert sorted(got, key=str) == sorted(brute_removed([r[:2] for r in rows]), key=str)
    for r in out.collect():
        assert hashlib.sha256(" ".join(re.findall(WORD, r["text"] or "")).encode()).hexdigest() == r["kept_sha256"]
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    assert texts[20] == [r[1] for r in rows if r[0] == 20][0] and texts[2] is None
    assert substring_dedup.deduplicated(df.filter("false")).collect() == []


def test_groups_hold_their_capacity():
    rng = np.random.default_rng(2)
    one, two = rng.integers(0, 50, 1 << substring_dedup.ONE), rng.integers(0, 5, 1 << substring_dedup.TWO)
    one[7], two[3] = 5000, 4000
    of_one, of_two, parts, total = substring_dedup.groups(one, two, 1000)
    assert of_one[7] == -1 and (of_one >= 0).sum() == len(one) - 1 and parts[3] == 4 and of_two[3] + 4 <= total
    assert np.bincount(of_one[of_one >= 0], one[of_one >= 0]).max() <= 1050


def quality_set(spark, prose, n=400):
    rng, rows, labels = random.Random(8), [], []
    for i in range(n):
        t, bad = prose(rng.randrange(5, 200), i), i % 5 == 0
        if bad:
            t = [t.upper().replace(" ", "!! "), " ".join(w + rng.choice(["***", "%%%", "$$$"]) for w in t.split()), " ".join(w for w in t.split() for _ in range(8))][i // 5 % 3]
        rows.append((i, t, i, 0.1))
        labels.append((i, int(not bad), 0))
    return spark.createDataFrame(rows, "doc_id long, text string, label long, score double"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {r[0]: r[1] for r in labels}


def test_quality_classifier(spark, prose, odd):
    docs, labels, truth = quality_set(spark, prose)
    rows = quality_classifier.digest(docs, labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(rows) == 400 and 40 < len(held) < 120
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) >= 0.97
    assert np.mean([r["predicted"] for r in held if truth[r["doc_id"]]]) >= 0.97
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    got = quality_classifier.digest(odd[0], labels).collect()
    assert len(got) == len(odd[1]) and all(r["score"] is not None for r in got)
    none = quality_classifier.scored(odd[0], labels.select("doc_id", "quality").withColumnRenamed("quality", "label").filter("false")).collect()
    assert {r["score"] for r in none} == {0.5}
    assert quality_classifier.digest(odd[0].filter("false"), labels).collect() == []
    assert quality_classifier.digest(docs, labels.filter("false")).count() == 400


def test_quality_features_don_t_depend_on_the_batch(prose):
    texts = [prose(30, 1), None, "", "a", prose(50, 2), "A!! B!!"]
    flat, first = quality_classifier.features(pa.array(texts))
    for i, t in enumerate(texts):
        own, _ = quality_classifier.features(pa.array([t], pa.string()))
        assert flat[first[i] : first[i + 1]].tolist() == own.tolist()


def test_hinge_separates():
    rows, y = [np.array([i % 2, 2 + i % 3]) for i in range(30)], np.array([1.0 if i % 2 else -1.0 for i in range(30)])
    r = np.ones(8)
    w, b = quality_classifier.hinge(rows, y, r)
    assert all(quality_classifier.margin(x, w, r, b) * t > 0.5 for x, t in zip(rows, y, strict=True))


def test_language_id(spark, docs001, odd):
    from pyspark.sql import functions as F

    truth = {r["doc_id"]: (r["lang"], r["text"]) for r in docs001.select("doc_id", "lang", "text").collect()}
    rows = language_id.digest(docs001).collect()
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40 and np.mean([r["lang_pred"] == truth[r["doc_id"]][0] for r in held]) >= 0.97
    train = docs001.select("lang", "text")
    got = {r["n_words"]: r for r in language_id.identified(odd[0], train, carry=True).collect()}
    assert len(got) == len(odd[1]) and [got[i]["lang_pred"] for i in (1, 2, 3, 10)] == ["und"] * 4 and got[9]["lang_pred"] != "und"
    assert got[1]["score"] == 0.0
    assert {r["lang_pred"] for r in language_id.identified(odd[0], train.filter("false")).collect()} == {"und"}
    assert language_id.identified(odd[0], train.withColumn("lang", F.lit("en"))).filter("lang_pred = 'en'").count() > 5
    assert language_id.digest(docs001.filter("false")).collect() == []


@pytest.mark.parametrize("k", [2, 3, 4, 7, 12])
def test_codewords_are_apart(k):
    c = language_id.code(k)
    assert min((c[i] != c[j]).sum() for i in range(k) for j in range(i)) >= max(1, c.shape[1] // 4)


def brute_base(t):
    t = t or ""
    w = re.findall(WORD, t)
    lines = [x for x in t.split("\n") if re.search(WORD, x)]
    tri = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(tri)
    again = {j for i, x in enumerate(tri) if n[x] > 1 for j in (i, i + 1, i + 2)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)


def test_quality_rules_base(spark, odd, prose):
    df, rows = odd
    rows = rows + [(50, "a b c a b c a", "en"), (51, "l1\nl1\n \nl2\nl1", "en"), (52, "#*$%&|<> " * 20, "en"), (53, "w " * 200, "en"), (54, "a b c d\x0bb c d", "en")]
    df = spark.createDataFrame([(*r, i, "x", 0.5) for i, r in enumerate(rows)], df.schema)
    got = [(r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in quality_rules.digest(df).collect()]
    assert sorted(got, key=str) == sorted([(d, *brute_base(t)) for d, t, _ in rows], key=str)
    j = quality_rules.judged(df.drop("n_words"))
    assert j.count() == len(rows) and j.filter("kept and base_failed").count() == 0
    assert quality_rules.digest(df.filter("false")).collect() == []


def python_em(patterns, rounds, weight):
    k = len(quality_rules.RULES)
    pg, pb = np.array([0.01, 0.69, 0.3]) * weight, np.array([0.3, 0.69, 0.01]) * weight
    p, g, b = 0.8, np.tile(pg / pg.sum(), (k, 1)), np.tile(pb / pb.sum(), (k, 1))
    v, n = np.array([x for x, _ in patterns]), np.array([y for _, y in patterns], float)
    for _ in range(rounds):
        odds = np.log(p / (1 - p)) + sum(np.log(g[j][v[:, j] + 1] / b[j][v[:, j] + 1]) for j in range(k))
        a = n / (1 + np.exp(-np.clip(odds, -30, 30)))
        p = (a.sum() + 8) / (n.sum() + 10)
        for q, m, prior in ((a, g, pg), (n - a, b, pb)):
            for j in range(k):
                m[j] = (np.array([q[v[:, j] == u - 1].sum() for u in range(3)]) + prior) / (q.sum() + prior.sum())
    return p, g, b


def test_quality_rules_model(spark, prose):
    docs, _, truth = quality_set(spark, prose)
    t = quality_rules.voted(quality_rules.base(docs)).cache()
    m = quality_rules.model(t, rounds=12)
    want = python_em([(r["votes"], r["count"]) for r in t.groupBy("votes").count().collect()], 12, 20.0)
    assert abs(m[0] - want[0]) < 1e-9 and np.allclose(m[1], want[1]) and np.allclose(m[2], want[2])
    assert all(0 < x < 1 for x in quality_rules.accuracies(m).values())
    rows = [r for r in quality_rules.digest(docs).collect() if not r["base_failed"]]
    assert np.mean([r["kept"] for r in rows if truth[r["doc_id"]]]) >= 0.97
    assert np.mean([not r["kept"] for r in rows if not truth[r["doc_id"]]]) >= 0.9


def test_pipeline_stages(spark, docs001, tmp_path):
    import corpus_pipeline

    docs, seen = docs001, []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.select("doc_id", "text", "lang", "n_chars").collect()] if name != "packing" else None
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / str(i)))
        out, seen = spark.read.parquet(str(tmp_path / str(i))), [*seen, name]
        if name != "packing":
            assert out.columns == docs001.columns
            kept = {r["doc_id"]: r for r in out.collect()}
        rows = [(x["doc_id"], x["text"]) for x in before] if before else []
        if name == "language_id":
            assert all(x["doc_id"] in kept for x in before if re.search(r"[a-z]{2,}", x["text"] or "") and len(x["text"]) > 100)
        elif name == "quality_rules":
            for d, t in rows:
                n = brute_base(t)
                if n[0] < 50 or 100 * n[4] > 50 * n[0]:
                    assert d not in kept
        elif name == "near_dedup":
            assert set(kept) == {d for d, _, _, k in brute_components(rows, 5) if k}
        elif name == "substring_dedup":
            for d, _, _, sha in brute_removed(rows):
                assert hashlib.sha256(" ".join(re.findall(WORD, kept[d]["text"])).encode()).hexdigest() == sha and kept[d]["n_chars"] == len(kept[d]["text"])
        else:
            assert out.select("doc_id").distinct().count() == docs.count()
        docs = out
    assert seen == ["language_id", "quality_rules", "near_dedup", "substring_dedup", "packing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 0
