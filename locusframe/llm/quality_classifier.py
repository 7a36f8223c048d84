r"""Quality classifier: Naive Bayes support vectors.

A document's features are indicators of hashed n-grams of its whole text: byte trigrams; 1- to 4-grams of byte shapes (lower case,
upper case, digit, beyond ASCII, any other byte as it is); trigrams of word shapes (case, digits, last byte, same as the word before
or as the one two before), and which tenth of its words has each word shape. Indicators are scaled by their classes' log-count ratio
(smoothed by 1), and a linear model with L1 hinge loss is fitted to them by dual coordinate descent. Scores are sigmoids of the margin,
fitted on margins from four-fold cross-validation within the training rows.

The model is fitted on at most `max_train` labelled rows, those with the smallest hashes of doc_id; that bound is a parameter. Every
document is scored, whole.

Defined cases: null or empty texts have no features and the score of the bias alone; null labels and labels without document aren't
learnt from; repeated rows each get the score; with no training rows, or of one class only, all scores are the smoothed share of label
1; an empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import Words, mix, sliced

BITS = 18
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123], _SHAPE[65:91], _SHAPE[48:58], _SHAPE[128:] = 97, 65, 48, 200


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct features of each row, one row after the other, and where each row begins."""
    w = Words(column)
    n, rows = len(w.data), len(w.offs) - 1
    doc = np.repeat(np.arange(rows), np.diff(w.offs)).astype(np.uint64)
    raw, shape = w.data.astype(np.uint64), _SHAPE[w.data]
    keys = []

    def add(kind: int, h: np.ndarray, of: np.ndarray) -> None:
        f = mix(h * np.uint64(64) + np.uint64(kind)) >> np.uint64(64 - BITS)
        keys.append((of << np.uint64(BITS)) | f)

    def grams(kind: int, x: np.ndarray, k: int) -> None:
        if n < k:
            return
        h = x[: n - k + 1].copy()
        for j in range(1, k):
            h = h * np.uint64(257) + x[j : n - k + 1 + j]
        inside = doc[: n - k + 1] == doc[k - 1 :]
        # few distinct values per row: pack before hashing
        key = np.unique((doc[: n - k + 1][inside] << np.uint64(40)) | (h[inside] & np.uint64((1 << 40) - 1)))
        add(kind, key & np.uint64((1 << 40) - 1), key >> np.uint64(40))

    grams(0, raw, 3)
    for k in range(1, 5):
        grams(k, shape, k)
    if len(w.starts):
        of = np.repeat(np.arange(rows), np.diff(w.first))
        h = w.hashes()
        first, last = w.data[w.starts], _SHAPE[w.data[w.ends - 1]]
        up = ((first >= 65) & (first <= 90)).astype(np.uint64)
        second = w.data[np.minimum(w.starts + 1, w.ends - 1)]
        up += ((second >= 65) & (second <= 90)).astype(np.uint64) * np.uint64(2)
        same = np.zeros(len(h), np.uint64)
        for k in (1, 2):
            same[k:] += ((h[k:] == h[:-k]) & (of[k:] == of[:-k])).astype(np.uint64) * np.uint64(k)
        word = last * np.uint64(16) + up * np.uint64(4) + same
        of = of.astype(np.uint64)
        if len(word) > 2:
            inside = of[2:] == of[:-2]
            add(8, (word[:-2] * np.uint64(4096) + word[1:-1]) * np.uint64(4096) + word[2:], of[: len(word) - 2]) if inside.all() else add(8, ((word[:-2] * np.uint64(4096) + word[1:-1]) * np.uint64(4096) + word[2:])[inside], of[2:][inside])
        pair, count = np.unique((of << np.uint64(16)) | word, return_counts=True)
        total = np.diff(w.first)[(pair >> np.uint64(16)).astype(np.int64)]
        add(9, (pair & np.uint64(65535)) * np.uint64(16) + np.minimum(10 * count // total, 9).astype(np.uint64), pair >> np.uint64(16))
    flat = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
    first = np.searchsorted(flat, np.arange(rows + 1, dtype=np.uint64) << np.uint64(BITS))
    return (flat & np.uint64((1 << BITS) - 1)).astype(np.int32), first


def ratios(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Log-count ratio of each feature."""
    p, q = np.ones(1 << BITS), np.ones(1 << BITS)
    for x, label in zip(rows, y, strict=True):
        (p if label > 0 else q)[x] += 1
    return (np.log(p / p.sum()) - np.log(q / q.sum())).astype(np.float64)


def hinge(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, cost: float = 0.1, rounds: int = 30, seed: int = 0) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-hinge linear model on scaled indicators, by dual coordinate descent."""
    values = [r[x] for x in rows]
    norm = np.array([v @ v + 1 for v in values])
    w, bias, alpha, order = np.zeros(len(r)), 0.0, np.zeros(len(rows)), np.random.Generator(np.random.PCG64(seed))
    scale = np.array([np.sqrt(v @ v) or 1.0 for v in values])  # rows of length one: long texts don't weigh more
    norm = norm / scale**2
    for _ in range(rounds):
        worst = 0.0
        for i in order.permutation(len(rows)):
            x, v = rows[i], values[i] / scale[i]
            g = y[i] * (w[x] @ v + bias / scale[i]) - 1
            a = min(max(alpha[i] - g / norm[i], 0.0), cost * 100)
            if a != alpha[i]:
                step = (a - alpha[i]) * y[i]
                w[x] += step * v
                bias += step / scale[i]
                worst = max(worst, abs(a - alpha[i]))
                alpha[i] = a
        if worst < 1e-3:
            break
    return w, bias


def margin(x: np.ndarray, w: np.ndarray, r: np.ndarray, bias: float) -> float:
    v = r[x]
    s = np.sqrt(v @ v) or 1.0
    return float(w[x] @ v + bias) / s


def sigmoid_of(m: np.ndarray, y: np.ndarray, rounds: int = 100) -> tuple[float, float]:
    """Slope and offset of the sigmoid that fits labels to margins, with smoothed targets (Newton steps, damped)."""
    t = np.where(y > 0, ((y > 0).sum() + 1) / ((y > 0).sum() + 2), 1 / ((y < 0).sum() + 2))
    x = np.stack([m, np.ones_like(m)], 1)
    b = np.zeros(2)
    loss = lambda b: np.sum(np.logaddexp(0, x @ b) - t * (x @ b))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2), x.T @ (t - p))
        size = 1.0
        while size > 1e-6 and loss(b + size * step) > loss(b):
            size /= 2
        b = b + size * step
        if abs(size * step).max() < 1e-6:
            break
    return float(b[0]), float(b[1])


def fit(rows: list[np.ndarray], y: np.ndarray, folds: int = 4) -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """(weights of plain indicators, ratios, bias, slope, offset)."""
    if len(set(y.tolist())) < 2:
        share = ((y > 0).sum() + 1) / (len(y) + 2)
        return np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, 0.0, float(np.log(share / (1 - share)))
    m, fold = np.zeros(len(y)), np.arange(len(y)) % folds
    for k in range(folds):
        own = [i for i in range(len(y)) if fold[i] != k]
        if len(set(y[own].tolist())) == 2:
            r = ratios([rows[i] for i in own], y[own])
            w, bias = hinge([rows[i] for i in own], y[own], r)
            for i in np.flatnonzero(fold == k):
                m[i] = margin(rows[i], w, r, bias)
    r = ratios(rows, y)
    w, bias = hinge(rows, y, r)
    slope, offset = sigmoid_of(m, y)
    return w, r, bias, slope, offset


def scored(docs: DataFrame, train: DataFrame, max_train: int = 6000, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score of each row of docs. train: (doc_id, label 0 or 1); its texts are looked up in docs."""
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    some = train.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).filter("label is not null and doc_id is not null")
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_train)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            flat, first = features(b.column(2))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))], names=["doc_id", "label", "x"])

    texts = d.join(F.broadcast(some), "doc_id").select("doc_id", "label", "text")  # max_train rows at most
    got = texts.mapInArrow(learn, "doc_id long, label int, x array<int>").toArrow()
    rows = got.column("x").combine_chunks()
    flat, offs = rows.flatten().to_numpy(), rows.offsets.to_numpy() - (rows.offsets[0].as_py() if len(rows) else 0)
    ids, labels = got.column("doc_id").to_numpy(), got.column("label").to_numpy()
    order = sorted(range(len(ids)), key=lambda i: (int(mix(ids[i : i + 1].view(np.uint64))[0]), int(labels[i])))
    w, r, bias, slope, offset = fit([flat[offs[i] : offs[i + 1]] for i in order], np.array([1.0 if labels[i] > 0 else -1.0 for i in order]))
    shared = spark.sparkContext.broadcast(((w * r).astype(np.float32), (r * r).astype(np.float32), bias, slope, offset))  # 2 MB

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wr, rr, bias, slope, offset = shared.value
        for b in sliced(batches, "text", 1 << 20):
            flat, first = features(b.column(1))
            of = np.repeat(np.arange(b.num_rows), np.diff(first))
            up = np.bincount(of, wr[flat], b.num_rows) + bias
            length = np.sqrt(np.bincount(of, rr[flat], b.num_rows))
            m = up / np.where(length > 0, length, 1.0)
            p = 1 / (1 + np.exp(-np.clip(slope * m + offset, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p)], names=["doc_id", "score"])

    return d.mapInArrow(score, "doc_id long, score double")


def digest(documents: DataFrame, labels: DataFrame) -> DataFrame:
    held = lambda c: F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(5)) == 0
    train = labels.filter(~held(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    out = scored(documents.select("doc_id", "text"), train)
    return out.select("doc_id", held(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
