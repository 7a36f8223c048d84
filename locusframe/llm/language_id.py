r"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. One binary classifier per bit (naive Bayes over hashed byte bigrams and trigrams of the text,
ASCII lower-cased, other ASCII than letters as spaces; each language weighs alike in its side) predicts that bit's margin. Decoding is
loss-weighted: the language whose codeword has the least sum of logistic losses over the bits. `score` is the softmax of the negative
losses; `ambiguous` flags rows whose best two losses differ by less than `least_gap`. n-gram counts are taken over all training documents,
and are as many as languages times 2^16 at most.

Up to 7 languages get the exhaustive code of 2^(k-1) - 1 bits; more get the best of 200 seeded random codes by least distance.

Defined cases: a null text and a text without a letter are `und`, with score 0; a text in no learnt script gets the nearest language
with a low score; with nothing to learn from all rows are `und`; one language alone gets every row with a letter, at score 1; repeated rows
count as often as they occur. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import buffers, sliced

BITS = 16
_FOLD = np.full(256, 32, np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed bigrams and trigrams at each byte of all rows (a row's edges count as spaces; runs of spaces give bin 0), and row bounds."""
    data, offs = buffers(column)
    x = _FOLD[data]
    n = len(x)
    one, two = np.full(n, 32, np.uint32), np.full(n, 32, np.uint32)
    one[:-1], two[:-2] = x[1:], x[2:]
    ends = offs[1:][np.diff(offs) > 0]
    one[ends - 1] = 32
    two[ends - 1] = 32
    two[np.maximum(ends - 2, 0)] = 32
    mult = np.uint32(2654435761)
    pair = (x * np.uint32(256) + one) * mult >> np.uint32(32 - BITS)
    three = ((x * np.uint32(65536) + one * np.uint32(256) + two) ^ np.uint32(0x5BD1E995)) * mult >> np.uint32(32 - BITS)
    blank = (x == 32) & (one == 32)
    return np.where(blank, 0, pair), np.where(blank, 0, three), offs


def code(k: int, seed: int = 7) -> np.ndarray:
    """Codewords (k, bits) of +1 and -1."""
    if k == 1:
        return np.ones((1, 1))
    if k <= 7:
        bits = (np.arange(1, 1 << k - 1)[None, :] >> np.arange(k - 1)[:, None]) & 1
        return np.vstack([np.ones((1, bits.shape[1])), 1.0 - 2 * bits])
    rng, best, dist = np.random.Generator(np.random.PCG64(seed)), None, -1
    for _ in range(200):
        c = rng.choice([-1.0, 1.0], (k, int(np.ceil(10 * np.log2(k)))))
        d = min((c.shape[1] - c[i] @ c[j]) / 2 for i in range(k) for j in range(i))
        if d > dist and (np.abs(c.sum(0)) < k).all():
            best, dist = c, d
    return best


def learnt(train: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, codewords and weights (bin, bit) from (lang, text)."""
    names = sorted(r[0] for r in train.filter("lang is not null").select("lang").distinct().collect())  # a row a language
    if not names:
        return [], np.ones((0, 1)), np.zeros((1 << BITS, 1), np.float32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(names), 1 << BITS), np.int64)
        place = {x: i for i, x in enumerate(names)}
        for b in sliced(batches, "text"):
            pair, three, offs = grams(b.column(1))
            of = np.repeat(np.array([place[x] for x in b.column(0).to_pylist()], np.int64), np.diff(offs))
            for x in (pair, three):
                total += np.bincount((of << BITS) + x, minlength=total.size).reshape(total.shape)
        lang, bin_ = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bin_), pa.array(total[lang, bin_])], names=["lang", "bin", "n"])

    found = train.filter("lang is not null").select("lang", "text").mapInArrow(count, "lang long, bin long, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    total = np.zeros((len(names), 1 << BITS))
    total[found["lang"].to_numpy(np.int64), found["bin"].to_numpy(np.int64)] = found["n"].to_numpy(np.float64)
    total[:, 0] = 0
    share = (total + 0.5) / (total + 0.5).sum(1, keepdims=True)
    words = code(len(names))
    weights = np.zeros((1 << BITS, words.shape[1]), np.float32)
    for bit in range(words.shape[1]):
        if (words[:, bit] > 0).any() and (words[:, bit] < 0).any():
            weights[:, bit] = np.log(share[words[:, bit] > 0].mean(0)) - np.log(share[words[:, bit] < 0].mean(0))
    weights[0] = 0
    return names, words, weights


def identified(docs: DataFrame, train: DataFrame, doc_id: str = "doc_id", text: str = "text", least_gap: float = 0.5, scale: float = 12.0, carry: bool = False) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous of each row of docs. train: (lang, text). With carry, all columns of docs instead of doc_id
    (those of the names that are added are replaced)."""
    names, words, weights = learnt(train)
    shared = docs.sparkSession.sparkContext.broadcast((words, weights))  # 2^16 rows of a float a bit
    kept = [f for f in docs.schema if f.name not in ("lang_pred", "score", "ambiguous")] if carry else [T.StructField("doc_id", docs.schema[doc_id].dataType)]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    own = [F.col(f"`{f.name}`") for f in kept] if carry else [F.col(f"`{doc_id}`").alias("doc_id")]
    d = docs.select(*own, F.col(f"`{text}`").alias("__text"), F.coalesce(F.col(f"`{text}`").rlike(r"\p{L}"), F.lit(False)).alias("__letter"))
    n = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, weights = shared.value
        for b in sliced(batches, "__text", 1 << 19):
            pair, three, offs = grams(b.column(n))
            full = np.flatnonzero(np.diff(offs))
            used = np.zeros(b.num_rows)
            sums = np.zeros((b.num_rows, weights.shape[1]))
            if len(full):
                sums[full] = np.add.reduceat(weights[pair] + weights[three], offs[:-1][full], axis=0)
                used[full] = np.add.reduceat((pair != 0).astype(np.int64), offs[:-1][full])
            f = scale * sums / np.maximum(2 * used, 1)[:, None]
            loss = np.logaddexp(0, -f[:, None, :] * words[None, :, :]).sum(2) if len(names) else np.zeros((b.num_rows, 0))
            letter = b.column(n + 1).to_numpy(zero_copy_only=False).astype(bool)
            if len(names):
                best = loss.argmin(1)
                p = np.exp(-(loss - loss.min(1, keepdims=True)))
                score = 1 / p.sum(1)
                gap = np.partition(loss, 1, axis=1)[:, 1] - loss.min(1) if len(names) > 1 else np.full(b.num_rows, np.inf)
            else:
                letter[:] = False
                best, score, gap = np.zeros(b.num_rows, int), np.zeros(b.num_rows), np.zeros(b.num_rows)
            lang = [names[k] if ok else "und" for k, ok in zip(best.tolist(), letter.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(lang, pa.string()), pa.array(np.where(letter, score, 0.0)), pa.array((gap < least_gap) | ~letter)], names=[x.name for x in schema])

    return d.mapInArrow(run, schema)


def digest(documents: DataFrame) -> DataFrame:
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    out = identified(documents.select("doc_id", "text"), documents.filter(~F.coalesce(held, F.lit(False))).select("lang", "text"))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "ambiguous")
