r"""Repeated passages, by prefix-partitioned suffix trees.

The suffixes are those that begin at a word. Only nodes at least `window` words deep matter, so a suffix is cut to its first `window`
words, and these are a 56-bit fingerprint: a leaf is (fingerprint, document, position), about 8 bytes instead of the 80 of its text. Only
leaves of one group, that is of one class of prefixes, are compared, so a window is taken for another with a chance of capacity / 2^56
(4e-11), whatever the size of the input.

1. All suffixes are counted by prefix: by the first word and by the first two words (in 4096 and 65536 classes of their hashes).
2. Prefixes have variable length: one word where the class fits in a group, two words where it doesn't, all `window` words where even
   that doesn't. Small classes share a group, so each group holds about `capacity` leaves. The table of groups has a fixed size.
3. Each task sends leaves to their groups, packed. Within a task's slice of documents a window that several documents share goes out
   for the smallest document only; the others are known to be repeats already, so a very common passage is one leaf per slice.
4. A group's subtree is built by sorting its leaves. A run of equal prefixes is an internal node of depth `window` or more; in it all
   leaves but those of the smallest document are repeats. They go out packed by classes of documents, as many as groups, and a class is
   unpacked to a row for each document. Runs of repeats in a document are its maximal repeats.

A word is removed if a repeat covers it, all judged on the input. Removing takes the word's bytes and the white space after it.

Defined cases: null text has no words and stays null; a null id ranks above all others; rows with equal id don't remove each other's
words, as neither is smaller, and rows are told apart by id and text, so equal rows get equal results; texts shorter than a window
stay; an empty table gives an empty result; other columns pass unchanged (names of the output's own columns are replaced).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import Words, mix, sliced

ONE, TWO = 12, 16  # bits of the classes of one-word and two-word prefixes
LAST = np.iinfo(np.int64).max


def _text_hash(text: str) -> Column:
    """32 bits that tell apart rows that repeat an id with another text."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit(""))).bitwiseAND(F.lit(0xFFFFFFFF))


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), _text_hash(text).alias("th"), F.col(f"`{text}`").alias("text"))


def _windows(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprint of each window, classes of its one- and two-word prefix, and how many windows precede each row."""
    w = Words(column)
    h = w.hashes()
    prints, first = w.grams(h, n)
    at = np.arange(first[-1]) + np.repeat(w.first[:-1] - first[:-1], np.diff(first))
    one = (h[at] >> np.uint64(64 - ONE)).astype(np.int32)
    two = (mix(h[at] * np.uint64(3) + h[at + 1 if n > 1 else at]) >> np.uint64(64 - TWO)).astype(np.int32)
    return prints, one, two, first


def _counts(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by one-word and two-word class, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << ONE) + (1 << TWO), np.int64)
        for b in sliced(batches, "text"):
            _, one, two, _ = _windows(b.column(0), n)
            total[: 1 << ONE] += np.bincount(one, minlength=1 << ONE)
            total[1 << ONE :] += np.bincount(two, minlength=1 << TWO)
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(total[full])], names=["k", "n"])

    found = rows.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()  # 69632 rows at most
    total = np.zeros((1 << ONE) + (1 << TWO), np.int64)
    total[found["k"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    return total[: 1 << ONE], total[1 << ONE :]


def groups(one: np.ndarray, two: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Group of each one-word class (-1: by two words), first group and number of groups of each two-word class, and their total."""

    def filled(counts: np.ndarray, start: int) -> np.ndarray:
        return start + (np.cumsum(counts) - counts) // max(1, capacity)

    small = one <= capacity
    of_one = np.where(small, filled(np.where(small, one, 0), 0), -1).astype(np.int64)
    start = int(of_one.max()) + 1
    # two-word classes hold suffixes of all one-word classes; those of small ones only make the estimate generous
    parts = np.maximum(1, -(-two // max(1, capacity)))
    many = parts > 1
    of_two = filled(np.where(many, 0, two), start)
    start = int(of_two.max()) + 1
    of_two = np.where(many, start + np.cumsum(np.where(many, parts, 0)) - np.where(many, parts, 0), of_two)
    return of_one, of_two, parts, start + int(parts[many].sum())


_LEAVES = "group long, docs binary, counts binary, pos binary, prints binary"
_FLAGS = "bucket long, docs binary, counts binary, pos binary"
PRINT = 7  # bytes of a fingerprint


def _planes(x: np.ndarray) -> bytes:
    """Integers as all their first bytes, then all their second bytes and so on: those of small numbers compress to nothing."""
    x = np.ascontiguousarray(x)
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(b: bytes, kind: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _steps(pos: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Ascending positions, document after document, as differences; each document's first as it is."""
    out = np.diff(pos, prepend=0)
    first = np.cumsum(counts) - counts
    out[first] = pos[first]
    return out


def _unsteps(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    c = np.cumsum(d, dtype=np.int64)
    first = np.cumsum(counts) - counts
    return c - np.repeat(c[first] - d[first], counts)


def _packed(ids: np.ndarray, th: np.ndarray, counts: np.ndarray, pos: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Positions in documents, document after document, as three values."""
    docs = _planes(np.diff(ids, prepend=0).astype("<i8")) + th.astype("<u4").tobytes()
    return docs, _planes(counts.astype("<u4")), _planes(_steps(pos.astype(np.int64), counts).astype("<u4"))


def _unpacked(docs: bytes, counts: bytes, pos: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    c = _unplanes(counts, "<u4").astype(np.int64)
    ids = np.cumsum(_unplanes(docs[: 8 * len(c)], "<i8"))
    return ids, np.frombuffer(docs[8 * len(c) :], "<u4").astype(np.int64), c, _unsteps(_unplanes(pos, "<u4"), c).astype(np.uint32)


def _all_unpacked(t: pa.Table) -> list[np.ndarray]:
    parts = [_unpacked(*x) for x in zip(*(t.column(c).to_pylist() for c in ("docs", "counts", "pos")), strict=True)]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, np.int64)] * 3 + [np.empty(0, np.uint32)]


def _leaves(rows: DataFrame, n: int, capacity: int) -> tuple[DataFrame, int]:
    """Packed leaves by group, and the number of groups. Rows without prints are repeats already known."""
    of_one, of_two, parts, total = groups(*_counts(rows, n), capacity)
    shared = rows.sparkSession.sparkContext.broadcast((of_one, of_two, parts))  # 1 MB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_one, of_two, parts = shared.value
        for b in sliced(batches, "text", 4 << 20):
            ids, th = b.column(0).fill_null(LAST).to_numpy(), b.column(1).to_numpy().astype(np.int64)
            prints, one, two, first = _windows(b.column(2), n)
            if not len(prints):
                continue
            doc = np.repeat(np.arange(len(ids)), np.diff(first))
            pos = (np.arange(len(prints)) - first[doc]).astype(np.uint32)
            order = np.argsort(prints, kind="stable")
            s = prints[order]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            least = np.minimum.reduceat(ids[doc[order]], new)
            later = np.zeros(len(prints), bool)
            later[order] = ids[doc[order]] > np.repeat(least, np.diff(np.append(new, len(s))))
            if later.any():
                d, c = np.unique(doc[later], return_counts=True)
                yield _batch([(int(ids[d[0]]) % max(1, total), *_packed(ids[d], th[d], c, pos[later]), None)])
            at = np.flatnonzero(~later)
            g = of_one[one[at]]
            far = np.flatnonzero(g < 0)
            g[far] = of_two[two[at[far]]] + (prints[at[far]] % parts[two[at[far]]].astype(np.uint64)).astype(np.int64)
            order = np.argsort(g, kind="stable")
            g, at = g[order], at[order]
            bounds = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1], [True]]))
            out = []
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                own = at[lo:hi]
                d, c = np.unique(doc[own], return_counts=True)
                out.append((int(g[lo]), *_packed(ids[d], th[d], c, pos[own]), prints[own].view(np.uint8).reshape(-1, 8)[:, :PRINT].tobytes()))
            yield _batch(out)

    return rows.mapInArrow(run, _LEAVES), total


def _batch(leaves: list[tuple]) -> pa.RecordBatch:
    cols = [pa.array(list(c), k) for c, k in zip(zip(*leaves, strict=True), [pa.int64(), *[pa.binary()] * 4], strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=[x.split()[0] for x in _LEAVES.split(", ")])


def _subtree(buckets: int):  # noqa: ANN202
    """The function of one group: its repeats, packed by class of documents."""

    def run(t: pa.Table) -> pa.Table:
        known = _all_unpacked(t.filter(pc.is_null(t.column("prints"))))
        t = t.filter(pc.is_valid(t.column("prints")))
        ids, th, counts, pos = _all_unpacked(t)
        raw = np.frombuffer(b"".join(t.column("prints").to_pylist()), np.uint8).reshape(-1, PRINT)
        prints = np.zeros((len(raw), 8), np.uint8)
        prints[:, :PRINT] = raw
        prints = prints.view(np.uint64).ravel()
        repeat = np.zeros(len(prints), bool)
        leaf = np.repeat(np.arange(len(ids), dtype=np.int32), counts)
        if len(prints):
            order = np.argsort(prints, kind="stable")
            s = prints[order]
            new = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            own = ids[leaf[order]]
            repeat[order] = own > np.repeat(np.minimum.reduceat(own, new), np.diff(np.append(new, len(s))))
        d, c = np.unique(leaf[repeat], return_counts=True)
        out = []
        for i, h, n, p in ((ids[d], th[d], c, pos[repeat]), known):
            bucket = (mix(i.view(np.uint64) ^ h.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            first = np.cumsum(n) - n
            bounds = np.flatnonzero(np.concatenate([[True], np.diff(bucket[order]) != 0, [True]])) if len(order) else [0]
            for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
                k = order[lo:hi]
                at = np.arange(int(n[k].sum())) + np.repeat(first[k] - (np.cumsum(n[k]) - n[k]), n[k])
                out.append((int(bucket[k[0]]), *_packed(i[k], h[k], n[k], p[at])))
        cols = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table([pa.array(list(x), k) for x, k in zip(cols, [pa.int64(), *[pa.binary()] * 3], strict=True)], names=["bucket", "docs", "counts", "pos"])

    return run


def _by_document(t: pa.Table) -> pa.Table:
    """The repeats of one class of documents: (doc_id, th, flags), a row a document."""
    ids, th, counts, pos = _all_unpacked(t)
    order = np.lexsort((th, ids))
    new = np.flatnonzero(np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(th[order]) != 0)]))
    row = np.empty(len(order), np.int64)
    row[order] = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(order))))
    both = np.unique(np.repeat(row, counts) << 32 | pos)
    bounds = np.searchsorted(both >> 32, np.arange(len(new) + 1))
    flags = [_planes(np.diff(both[a:z] & 0xFFFFFFFF, prepend=0).astype("<u4")) for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
    return pa.table([pa.array(ids[order[new]]), pa.array(th[order[new]]), pa.array(flags, pa.binary())], names=["doc_id", "th", "flags"])


def repeats(rows: DataFrame, n: int, capacity: int) -> DataFrame:
    """(doc_id, th, flags): where windows that a smaller document has begin, a row for each document that has some."""
    leaves, total = _leaves(rows, n, capacity)
    return leaves.groupBy("group").applyInArrow(_subtree(max(1, total)), _FLAGS).groupBy("bucket").applyInArrow(_by_document, "doc_id long, th long, flags binary")


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 13, capacity: int = 3 << 20, texts: bool = True) -> DataFrame:
    """The rows of docs with the cleaned text in `text`, and n_words, n_removed, kept_sha256 (of the kept words, joined by one space).
    texts=False leaves the text out."""
    own = {"n_words": T.LongType(), "n_removed": T.LongType(), "kept_sha256": T.StringType()}
    flags = repeats(_rows(docs, doc_id, text), window, capacity)
    flags = flags.select(F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("__id"), F.col("th").alias("__th"), F.col("flags").alias("__flags"))
    kept = [f for f in docs.schema if f.name not in own]
    d = docs.select(*[F.col(f"`{f.name}`") for f in kept], _text_hash(text).alias("__th0"))
    t = d.join(flags, d[f"`{doc_id}`"].cast("long").eqNullSafe(F.col("__id")) & (F.col("__th0") == F.col("__th")), "left")
    rest = [f.name for f in kept if f.name != text]
    t = t.select(*[F.col(f"`{c}`") for c in rest], F.col(f"`{text}`").alias("__text"), "__flags")
    schema = T.StructType([*(f for f in kept if f.name != text), *([T.StructField(text, T.StringType())] if texts else []), *(T.StructField(k, v) for k, v in own.items())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "__text", 4 << 20):
            column = b.column(len(rest))
            w = Words(column)
            made, removed, shas = [], [], []
            data = w.data.tobytes()
            for i, flags in enumerate(b.column(len(rest) + 1).to_pylist()):
                lo, hi, a, z = w.first[i], w.first[i + 1], w.offs[i], w.offs[i + 1]
                if flags:
                    begin = np.zeros(hi - lo + 1, np.int32)
                    p = np.cumsum(_unplanes(flags, "<u4"), dtype=np.int64)
                    begin[p] += 1
                    begin[p + window] -= 1
                    gone = np.cumsum(begin)[:-1] > 0
                    removed.append(int(gone.sum()))
                    starts = np.append(w.starts[lo:hi], z)
                    edge = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                    cuts = [a, *starts[edge], z]
                    out = b"".join([data[x:y] for x, y in zip(cuts[::2], cuts[1::2], strict=True)])
                else:
                    removed.append(0)
                    out = data[a:z]
                shas.append(hashlib.sha256(b" ".join(out.split())).hexdigest())
                made.append(out)
            cols = list(b.columns[: len(rest)])
            if texts:
                cols.append(pa.array([None if null else y for null, y in zip(column.is_null().to_pylist(), made, strict=True)], pa.binary()).cast(pa.string()))
            cols += [pa.array(np.diff(w.first).astype(np.int64)), pa.array(removed, pa.int64()), pa.array(shas, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    return t.mapInArrow(run, schema)


def digest(documents: DataFrame) -> DataFrame:
    return deduplicated(documents.select("doc_id", "text"), texts=False)


SQL = r"""
with w as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
v as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as s from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from w)),
d as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by s) as m from v) where doc_id > m),
c as (select distinct doc_id, i + k as i from d, (select unnest(range(0, 13)) as k)),
x as (select w.doc_id, len(w.w) as n, list(c.i) as gone from w left join c on w.doc_id = c.doc_id group by w.doc_id, w.w)
select doc_id, cast(n as bigint) as n_words, cast(len(list_filter(gone, lambda g: g is not null)) as bigint) as n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, n + 1), lambda i: not coalesce(list_contains(gone, i), false)), lambda i: w[i]), ' ')) as kept_sha256
from x join w using (doc_id)
"""
