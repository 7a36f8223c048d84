r"""Packing by lexical retrieval over the whole corpus.

Documents are dealt over shards of about `shard_tokens` tokens by a hash; each shard is written once with its BM25 inverted index over
token ids, with document frequencies and the mean length counted over all documents of the input. A query is all terms of a document.
It goes to every shard, and the best `tries` unused documents of all shards are its neighbours, whichever shard they lie in. A shard
sends as many; what scores above the last one of each shard that may have more is exact too, and comes along as far as 32 times `tries`.

Windows are filled in rounds by the driver, which holds a flag and a length a document and the windows of the round. A window takes its
seed, then the seed's unused neighbours in the order of their scores, whole ones as long as they fit, then a cut of the best that is
left, whose rest is the next seed. A round fills at most `batch` windows and at most half of those that remain, in turn, from neighbours
asked for at its start; where other windows of the round have taken all that a window was told of, it asks again in the next round, and
a seed that a window before it has taken opens none. The last 1024 windows, if they hold at most 50,000 documents, are filled one by one on the
driver. Where a seed has no neighbour left, the next unused documents follow. So each window is full; what remains in the end goes to
sequences whose lengths are powers of two, which need no padding. A document of a whole window or more gives full windows of its own,
and its rest is packed like a short document.

Each window's query meets each shard: the work grows with the square of the corpus.

Defined cases: a null or empty text is its end mark alone; a null id is carried along; repeated rows are packed as often as they
occur; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, word_bpe, worker

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
K1, B = 1.2, 0.75


def statistics(tokens: DataFrame, wide: int) -> tuple[np.ndarray, int, int]:
    """Document frequency of each id, number of documents and number of tokens, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker.lean()
        df, n, total = np.zeros(1 << 16, np.int64), 0, 0
        for b in batches:
            for x in b.column(0):
                ids = np.frombuffer(x.as_buffer(), f"<u{wide}")
                own = np.unique(ids)
                if len(own) and own[-1] >= len(df):
                    df = np.concatenate([df, np.zeros(int(own[-1]) + 1 - len(df), np.int64)])
                df[own] += 1
                n, total = n + 1, total + len(ids)
        full = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *full.tolist()], pa.int64()), pa.array([n, total, *df[full].tolist()], pa.int64())], names=["id", "n"])

    found = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()  # as many rows as the vocabulary
    by = dict(zip(found["id"].tolist(), found["n"].tolist(), strict=True))
    df = np.zeros(max([0, *by]) + 1, np.int64)
    for k, v in by.items():
        if k >= 0:
            df[k] = v
    return df, by.get(-1, 0), by.get(-2, 0)


def postings(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms, how many documents each is in, and those documents with the term's count there."""
    own = [np.unique(ids, return_counts=True) for ids in docs]
    t, c = np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own]).astype(np.int32)
    d = np.repeat(np.arange(len(docs), dtype=np.int32), [len(x) for x, _ in own])
    order = np.argsort(t, kind="stable")
    term, count = np.unique(t, return_counts=True)
    return term.astype(np.int32), count.astype(np.int32), d[order], c[order]


class Index:
    """BM25 inverted index of one shard. All terms of a query count: those in more than a document of `dense` by a matrix (of CELLS at
    most, the most frequent first), others by lists."""

    CELLS = 1 << 23
    STEP = 1 << 20

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float, dense: int = 32):
        self.docs, self.alive = docs, np.ones(len(docs), np.float32)
        self._build(postings(docs), np.array([len(x) for x in docs]), idf, mean, dense, None)

    @classmethod
    def stored(cls, lists: tuple[np.ndarray, ...], lens: np.ndarray, idf: np.ndarray, mean: float, alive: np.ndarray, dense: int = 32) -> Index:
        """An index of the documents alive, by the shard's postings."""
        self = cls.__new__(cls)
        self.docs, self.alive = [], np.ones(int(alive.sum()), np.float32)
        self._build(lists, lens, idf, mean, dense, alive)
        return self

    def _build(self, lists: tuple[np.ndarray, ...], lens: np.ndarray, idf: np.ndarray, mean: float, dense: int, alive: np.ndarray | None) -> None:
        term, count, doc, tf = lists
        t = np.repeat(term, count)
        if alive is not None:
            on = alive[doc]
            t, doc, tf, lens = t[on], (np.cumsum(alive) - 1).astype(np.int32)[doc[on]], tf[on], lens[alive]
        self.n = len(lens)
        tf, long = tf.astype(np.float32), (K1 * (1 - B + B * lens / mean)).astype(np.float32)
        w = idf.astype(np.float32)[t]
        w *= tf * np.float32(K1 + 1)
        tf += long[doc]
        w /= tf
        self.doc, self.weight = doc, w
        self.first = np.searchsorted(t, np.arange(len(idf) + 1))
        found = np.diff(self.first)
        often = np.flatnonzero(found * dense > self.n)
        if len(often) * self.n > self.CELLS:
            often = np.sort(often[np.argsort(-found[often], kind="stable")[: self.CELLS // self.n]])
        self.column = np.full(len(idf), -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.matrix = np.zeros((len(often), self.n), np.float32)
        for i, x in enumerate(often.tolist()):
            a, z = self.first[x], self.first[x + 1]
            self.matrix[i, doc[a:z]] = w[a:z]

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """Score of each document alive for each query (its distinct terms)."""
        flat, row = np.concatenate(queries), np.repeat(np.arange(len(queries)), [len(q) for q in queries])
        column = self.column[flat]
        often = column >= 0
        if len(queries) < 4:
            out = np.stack([self.matrix[column[often & (row == i)]].sum(0) for i in range(len(queries))])
        else:
            asked, place = np.unique(column[often], return_inverse=True)
            ask = np.zeros((len(queries), len(asked)), np.float32)
            ask[row[often], place] = 1
            out = ask @ self.matrix[asked]
        term, row = flat[~often], row[~often]
        begin, size = self.first[term], self.first[term + 1] - self.first[term]
        ahead, at = np.concatenate([[0], np.cumsum(size)]), 0
        while at < len(size):
            end = max(at + 1, int(np.searchsorted(ahead, ahead[at] + self.STEP, "right")) - 1)
            n = size[at:end]
            place = np.arange(ahead[at], ahead[end]) + np.repeat(begin[at:end] - ahead[at:end], n)
            np.add.at(out.reshape(-1), np.repeat(row[at:end] * self.n, n) + self.doc[place], self.weight[place])
            at = end
        out *= self.alive
        return out

    def neighbours(self, seed: int, k: int) -> np.ndarray:
        """Up to k unused documents with a term of the seed, best first."""
        return best(self.scores([np.unique(self.docs[seed]).astype(np.int64)])[0], k)

    def best(self, queries: list[np.ndarray], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Up to k documents alive and their scores for each query, best first; of all scores, CELLS / 2 at most are held at once."""
        step = max(1, self.CELLS // 2 // self.n)
        for at in range(0, len(queries), step):
            for score in self.scores(queries[at : at + step]):
                top = best(score, k)
                yield top, score[top]


def best(score: np.ndarray, k: int) -> np.ndarray:
    """Up to k places of scores above 0, the highest first, equal ones in order."""
    top = np.arange(len(score))
    if len(score) > k:
        least = np.partition(score, len(score) - k)[len(score) - k]
        over, same = np.flatnonzero(score > least), np.flatnonzero(score == least)
        top = np.sort(np.concatenate([over, same[: k - len(over)]]))
    top = top[np.argsort(-score[top], kind="stable")]
    return top[score[top] > 0]


def alike(queries: list[np.ndarray], groups: int = 8, terms: int = 1024) -> np.ndarray:
    """An order of the queries that puts those with many terms in common, as of one language, side by side: a block of them has fewer terms."""
    flat, row = np.concatenate(queries), np.repeat(np.arange(len(queries)), [len(q) for q in queries])
    own, place, count = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.full(len(own), -1)
    column[np.argsort(-count, kind="stable")[:terms]] = np.arange(min(terms, len(own)))
    on = column[place] >= 0
    x = np.zeros((len(queries), min(terms, len(own))), np.float32)
    x[row[on], column[place[on]]] = 1
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    center = x[:: max(1, len(x) // groups)][:groups]
    for _ in range(4):
        group = (x @ center.T).argmax(1)
        center = np.stack([x[group == i].mean(0) if (group == i).any() else c for i, c in enumerate(center)])
        center /= np.maximum(np.linalg.norm(center, axis=1, keepdims=True), 1e-9)
    return np.argsort((x @ center.T).argmax(1), kind="stable")


SHARD = "shard int, n int, unused long, names binary, nulls binary, lens binary, ids binary, term binary, count binary, doc binary, tf binary"
HITS = "block int, size binary, g binary, score binary"
PLACED = "shard int, pos int, start long, length long, sequence_id long, offset long"


def indexed(tokens: DataFrame, wide: int, shards: int, window: int) -> DataFrame:
    """A row a shard (SHARD): its documents in order, with their postings."""

    def run(t: pa.Table) -> pa.Table:
        worker.lean()
        t = t.combine_chunks()
        ids = [np.frombuffer(x.as_buffer(), f"<u{wide}") for x in t.column("ids")]
        names, shard = t.column("doc_id").to_pylist(), t.column("shard")[0].as_py()
        order = sorted(range(len(ids)), key=lambda i: (names[i] is None, names[i] or 0, len(ids[i]), ids[i].tobytes()))
        ids, names = [ids[i] for i in order], [names[i] for i in order]
        lens = np.array([len(x) for x in ids], np.int64)
        own = [np.array([x or 0 for x in names], np.int64), np.array([x is None for x in names]), lens, np.concatenate(ids), *postings(ids)]
        cols = [pa.array([shard], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([int((lens % window).sum())]), *(pa.array([x.tobytes()], pa.binary()) for x in own)]
        return pa.table(cols, names=[x.split()[0] for x in SHARD.split(", ")])

    dealt = tokens.select(F.pmod(F.xxhash64("doc_id", "n_tokens", F.crc32("ids")), F.lit(shards)).cast("int").alias("shard"), F.col("doc_id").cast("long").alias("doc_id"), "ids")
    return store.written(dealt.groupBy("shard").applyInArrow(run, SHARD), "packing-index")


class Search:
    """Queries to all shards of an index."""

    BLOCK = 256

    def __init__(self, index: DataFrame, idf: np.ndarray, mean: float, wide: int, window: int, k: int, most: int = 0):
        self.index, self.window, self.k, self.most = index, window, k, max(k, most)
        rows = index.select("shard", "n", "unused", "lens").orderBy("shard").collect()  # a row for 8 million tokens
        self.shards = [r["shard"] for r in rows]
        self.first = dict(zip(self.shards, np.cumsum([0, *(r["n"] for r in rows)]).tolist(), strict=False))
        self.n, self.unused = sum(r["n"] for r in rows), sum(r["unused"] for r in rows)
        self.lens = np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(r["lens"], np.int64) for r in rows)]).astype(np.int32)  # 4 bytes a document
        self.spark = index.sparkSession
        self.idf, self.mean = idf, mean
        self.model = self.spark.sparkContext.broadcast((idf, mean, self.first))  # as large as the vocabulary

    def documents(self, places: list[int]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
        """Length of each document, its distinct terms and their counts."""
        first, wanted = self.first, np.array(sorted(places), np.int64)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.lean()
            for b in batches:
                for i in range(len(b)):
                    shard, n = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                    term, count, doc, tf = (np.frombuffer(b.column(c)[i].as_buffer(), np.int32) for c in range(2, 6))
                    mine = wanted[np.searchsorted(wanted, first[shard]) : np.searchsorted(wanted, first[shard] + n)]
                    asked = np.zeros(n, bool)
                    asked[mine - first[shard]] = True
                    at = np.flatnonzero(asked[doc])
                    t = term[np.searchsorted(np.cumsum(count), at, "right")]
                    order = np.argsort(doc[at], kind="stable")
                    size = np.bincount(doc[at], minlength=n)[mine - first[shard]]
                    yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (mine, size, t[order], tf[at][order])], names=["g", "size", "terms", "tf"])

        begins = np.array(list(self.first.values()))
        of = [list(self.first)[i] for i in np.unique(np.searchsorted(begins, wanted, "right") - 1).tolist()]
        rows = self.index.filter(F.col("shard").isin(of)).select("shard", "n", "term", "count", "doc", "tf").mapInArrow(run, "g binary, size binary, terms binary, tf binary").collect()  # a batch of windows
        out = {}
        for r in rows:
            terms, tf = np.frombuffer(r["terms"], np.int32).astype(np.int64), np.frombuffer(r["tf"], np.int32)
            at = 0
            for g, n in zip(np.frombuffer(r["g"], np.int64).tolist(), np.frombuffer(r["size"], np.int64).tolist(), strict=True):
                out[g], at = (int(self.lens[g]), terms[at : at + n], tf[at : at + n]), at + n
        return out

    def neighbours(self, queries: list[np.ndarray], used: np.ndarray) -> list[np.ndarray]:
        """(document, length) of each query's best unused documents of the whole corpus: k of them, and those behind them as far as
        they are known to be the next, up to `most`. Fewer than k are all there are."""
        model, block, k, most, window = self.model, self.BLOCK, self.k, self.most, self.window
        order = alike(queries)
        queries = [queries[i] for i in order.tolist()]
        asked = self.spark.sparkContext.broadcast((np.packbits(used), np.concatenate(queries).astype(np.int32), np.cumsum([len(q) for q in queries])))  # a bit a document, and a batch of windows

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            worker.lean()
            (idf, mean, first), (bits, flat, ends) = model.value, asked.value
            own = [x.astype(np.int64) for x in np.split(flat, ends[:-1])]
            for b in batches:
                for i in range(len(b)):
                    row = {c: b.column(c)[i] for c in b.schema.names}
                    lens, begin = np.frombuffer(row["lens"].as_buffer(), np.int64), first[row["shard"].as_py()]
                    alive = np.unpackbits(bits[begin // 8 : (begin + len(lens)) // 8 + 1])[begin % 8 : begin % 8 + len(lens)] == 0
                    alive &= lens % window > 0
                    place = np.flatnonzero(alive)
                    if not len(place):
                        continue
                    index = Index.stored(tuple(np.frombuffer(row[c].as_buffer(), np.int32) for c in ("term", "count", "doc", "tf")), lens, idf, mean, alive)
                    for at in range(0, len(own), block):
                        tops = list(index.best(own[at : at + block], k))
                        cols = [np.array([len(x) for x, _ in tops], np.int32), place[np.concatenate([x for x, _ in tops])] + begin, np.concatenate([s for _, s in tops])]
                        yield pa.RecordBatch.from_arrays([pa.array([at // block], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=[x.split()[0] for x in HITS.split(", ")])
                    del index
            worker.trimmed()

        def merged(t: pa.Table) -> pa.Table:
            size, g, score = (t.column(c).to_pylist() for c in ("size", "g", "score"))
            size, g, score = [np.frombuffer(x, np.int32) for x in size], np.concatenate([np.frombuffer(x, np.int64) for x in g]), np.concatenate([np.frombuffer(x, np.float32) for x in score])
            n = len(size[0])
            query, last = np.concatenate([np.repeat(np.arange(n), x) for x in size]), np.concatenate(size)
            # a shard that sent k may have more: whatever scores above its last one is known to be whole
            ends, bound = np.cumsum(last), np.zeros(n, np.float32)
            cut = last == k
            np.maximum.at(bound, np.tile(np.arange(n), len(size))[cut], score[ends[cut] - 1])
            order = np.lexsort((g, -score, query))
            rank = np.arange(len(order)) - np.searchsorted(query[order], np.arange(n))[query[order]]
            order = order[(rank < k) | (score[order] > bound[query[order]]) & (rank < most)]
            cols = [np.bincount(query[order], minlength=n).astype(np.int32), g[order], score[order]]
            return pa.table([pa.array([t.column("block")[0].as_py()], pa.int32()), *(pa.array([c.tobytes()], pa.binary()) for c in cols)], names=[x.split()[0] for x in HITS.split(", ")])

        hits = self.index.select("shard", "lens", "term", "count", "doc", "tf").mapInArrow(run, HITS).groupBy("block").applyInArrow(merged, HITS).collect()  # `most` places a window of the batch
        asked.unpersist()
        out = [np.zeros((0, 2), np.int64)] * len(queries)
        for r in hits:
            g = np.frombuffer(r["g"], np.int64)
            pairs = np.stack([g, self.lens[g]], 1)
            out[r["block"] * block : (r["block"] + 1) * block] = np.split(pairs, np.cumsum(np.frombuffer(r["size"], np.int32))[:-1])
        return [out[i] for i in np.argsort(order).tolist()]

    def rest(self, used: np.ndarray, also: set[int], most: int) -> Rest | None:
        """The unused documents and those of `also`, if they are at most `most`, searched on the driver."""
        places = np.flatnonzero(~used & (self.lens % self.window > 0))
        return Rest(self, places, self.documents(list({*places.tolist(), *also}))) if len(places) <= most else None


class Rest:
    """Search over the last documents, on the driver."""

    def __init__(self, search: Search, places: np.ndarray, found: dict[int, tuple[int, np.ndarray, np.ndarray]]):
        self.n, self.k, self.lens, self.places, self.found, self.idf, self.mean = search.n, search.k, search.lens, places, found, search.idf, search.mean
        self._index()

    def _index(self) -> None:
        own = [self.found[g] for g in self.places.tolist()]
        t, tf = (np.concatenate([np.zeros(0, np.int32), *(x[i] for x in own)]).astype(np.int32) for i in (1, 2))
        order = np.argsort(t, kind="stable")
        term, count = np.unique(t, return_counts=True)
        lists = term, count, np.repeat(np.arange(len(own), dtype=np.int32), [len(x[1]) for x in own])[order], tf[order]
        self.index = Index.stored(lists, self.lens[self.places].astype(np.int64), self.idf, self.mean, np.ones(len(own), bool)) if own else None

    def documents(self, places: list[int]) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
        return {g: self.found[g] for g in places}

    def neighbours(self, queries: list[np.ndarray], used: np.ndarray) -> list[np.ndarray]:
        alive = ~used[self.places]
        if 2 * alive.sum() < len(alive):
            self.places = self.places[alive]
            self._index()
            alive = np.ones(len(self.places), bool)
        if self.index is None:
            return [np.zeros((0, 2), np.int64)] * len(queries)
        self.index.alive = alive.astype(np.float32)
        tops = [self.places[x] for x, _ in self.index.best(queries, self.k)]
        return [np.stack([g, self.lens[g]], 1) for g in tops]


class Window:
    """A window in the making: its seed (-1 where the next unused document is to follow), what it holds, and whether the seed is in."""

    __slots__ = ("seed", "pieces", "used", "seeded")

    def __init__(self, seed: int, seeded: bool = False):
        self.seed, self.seeded, self.used = seed, seeded, 0
        self.pieces: list[tuple[int, int, int]] = []


def fill(search: Search | Rest, window: int, batch: int, last: int = 1024, few: int = 50_000) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length), all but the last ones of a whole window. The last windows, and `few` documents at
    most, are filled one by one on the driver."""
    used, begun, free = np.zeros(search.n, bool), {}, search.unused
    known: dict[int, tuple] = {}
    going: list[Window] = []
    carried: list[int] = []  # begun documents, which seed the next windows
    returned: list[int] = []  # begun documents that may be anyone's neighbours again
    at = 0

    def left(g: int, n: int) -> int:
        return n - begun.get(g, n - n % window)

    def put(w: Window, g: int, n: int) -> None:
        nonlocal free
        start, took = begun.get(g, n - n % window), min(left(g, n), window - w.used)
        free, used[g] = free - (0 if used[g] else left(g, n)), True
        w.pieces.append((g, start, took))
        w.used, begun[g] = w.used + took, start + took
        if begun[g] == n:
            del begun[g]

    while free:
        if isinstance(search, Search) and -(-free // window) <= last and (rest_ := search.rest(used, {*begun, *carried, *(w.seed for w in going if w.seed >= 0)}, few)):
            search, batch = rest_, 1
        size = max(1, min(batch, -(-free // window) // 2))
        chosen, going = going[:batch], going[batch:]
        keep, more = carried[: max(0, size - len(chosen))], carried[max(0, size - len(chosen)) :]
        for g in more:
            used[g], free = False, free + left(g, known[g][0])
        returned += more
        taken = set(keep)
        chosen += [Window(g) for g in keep]

        def following() -> int:
            nonlocal at
            while returned:
                if not used[g := returned.pop(0)] and g not in taken:
                    return g
            while at < search.n and (used[at] or at in taken or at in begun):
                at += 1
            return at if at < search.n else -1

        while len(chosen) < size:
            chosen.append(Window(-1))
        for w in chosen:
            if w.seed < 0 and (g := following()) >= 0:
                w.seed, w.seeded = g, False
                taken.add(g)
        chosen, rest = [w for w in chosen if w.seed >= 0], [w for w in chosen if w.seed < 0 and w.pieces]
        if new := [w.seed for w in chosen if w.seed not in known or not len(known[w.seed][1])]:
            known |= search.documents(new)
        near = search.neighbours([known[w.seed][1] for w in chosen], used) if chosen else []
        own, carried = set(keep), []
        for w, hits in zip(chosen, near, strict=True):
            n = known[w.seed][0]
            if not w.seeded:
                if used[w.seed] and w.seed not in own or not left(w.seed, n):
                    used[w.seed], w.seed = True, -1
                    rest += [w] if w.pieces else []
                    continue
                put(w, w.seed, n)
                w.seeded = True
            open_ = [tuple(x) for x in hits[~used[hits[:, 0]]][: search.k].tolist()]
            cut = -1
            for g, n in open_:
                if left(g, n) <= window - w.used:
                    put(w, g, n)
            if w.used < window and (g := next(((g, n) for g, n in open_ if not used[g]), None)):
                put(w, *g)
                cut, known[g[0]] = g[0], known.get(g[0], (g[1], _NONE))
            if w.used == window:
                yield w.pieces
                if cut >= 0:
                    carried.append(cut)
                if w.seed in begun:
                    carried.append(w.seed)
                continue
            if len(hits) < search.k:
                w.seed, w.seeded = -1, False
            rest.append(w)
        going = rest + going
        needed = {w.seed for w in going} | set(carried) | set(returned)
        known = {g: x for g, x in known.items() if g in needed}
    # the end of the corpus: what is left in order, then sequences of lengths that are powers of two
    tail = Window(-1)
    for g, start, n in [x for w in going for x in w.pieces] + [(g, begun[g], known[g][0] - begun[g]) for g in carried]:
        while n:
            took = min(n, window - tail.used)
            tail.pieces.append((g, start, took))
            tail.used, start, n = tail.used + took, start + took, n - took
            if tail.used == window:
                yield tail.pieces
                tail = Window(-1)
    while tail.used:
        room, pieces = 1 << tail.used.bit_length() - 1, []
        tail.used -= room
        while room:
            g, start, n = tail.pieces.pop(0)
            took = min(n, room)
            pieces.append((g, start, took))
            if took < n:
                tail.pieces.insert(0, (g, start + took, n - took))
            room -= took
        yield pieces


_NONE = np.zeros(0, np.int64)
FLUSH = 1 << 19


def placed(search: Search, window: int, batch: int) -> DataFrame:
    """Where the pieces of all sequences lie (PLACED), in tables of at most FLUSH rows and a window."""
    begins, shard = np.array(list(search.first.values()), np.int64), np.array(list(search.first), np.int64)
    tables, rows = [], []

    def flush() -> None:
        g, start, n, seq, offset = np.array(rows, np.int64).reshape(-1, 5).T
        i = np.searchsorted(begins, g, "right") - 1
        cols = [pa.array(shard[i], pa.int64()).cast(pa.int32()), pa.array(g - begins[i]).cast(pa.int32()), *(pa.array(x) for x in (start, n, seq + (len(search.first) << 32), offset))]
        t = search.spark.createDataFrame(pa.table(cols, names=[x.split()[0] for x in PLACED.split(", ")]), PLACED)
        tables.append(store.written(t, "packing-placed"))
        rows.clear()

    for seq, pieces in enumerate(fill(search, window, batch)):
        offset = 0
        for g, start, n in pieces:
            rows.append((g, start, n, seq, offset))
            offset += n
        if len(rows) >= FLUSH:
            flush()
    if rows or not tables:
        flush()
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def packed(tokens: DataFrame, wide: int = 2, window: int = 4096, shard_tokens: int = 1 << 23, tries: int = 32, batch: int = 2048) -> DataFrame:
    """The pieces (PIECES) of a written table of tokens (doc_id, n_tokens, ids), which is dropped."""
    df, n, total = statistics(tokens, wide)
    shards = max(1, -(-total // shard_tokens))
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    index = indexed(tokens, wide, shards, window)
    for path in {x.rsplit("/", 1)[0] for x in tokens.inputFiles()}:
        store.drop(tokens.sparkSession, path)
    search = Search(index, idf, max(1.0, total / max(1, n)), wide, window, tries + 1, 32 * tries)
    where = placed(search, window, batch)

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        worker.lean()
        doc, b = a.to_pylist()[0], b.sort_by([("sequence_id", "ascending"), ("offset", "ascending")])
        names, nulls, lens = np.frombuffer(doc["names"], np.int64), np.frombuffer(doc["nulls"], bool), np.frombuffer(doc["lens"], np.int64)
        ids, ends, whole = np.frombuffer(doc["ids"], f"<u{wide}"), np.cumsum(lens), lens // window
        p, turn = np.repeat(np.arange(len(lens)), whole), np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)
        own = [p, turn * window, np.full(len(p), window), (doc["shard"] << 32) + np.arange(len(p)), np.zeros(len(p), np.int64)]
        p, start, n, seq, offset = (np.concatenate([x, b.column(c).to_numpy()]) for x, c in zip(own, ("pos", "start", "length", "sequence_id", "offset"), strict=True))
        begin = (ends - lens)[p] + start
        crc = [zlib.crc32(ids[x : x + k].astype("<u4").tobytes()) for x, k in zip(begin.tolist(), n.tolist(), strict=True)]
        cols = [pa.array(names[p], pa.int64(), mask=nulls[p]), *(pa.array(np.asarray(x, np.int64)) for x in (start, n, np.array(crc, np.int64), lens[p], seq, offset))]
        return pa.table(cols, names=[x.split()[0] for x in PIECES.split(", ")])

    return index.select("shard", "names", "nulls", "lens", "ids").groupBy("shard").cogroup(where.groupBy("shard")).applyInArrow(run, PIECES)


def pack_documents(documents: DataFrame, path: str, end: int = 2, **options: int) -> DataFrame:
    """Pieces of all documents, tokenized by the file at `path`."""
    with open(path, encoding="utf-8") as f:
        wide = word_bpe.width(f.read())
    tokens = store.written(word_bpe.tokenized(documents, path, end), "tokens")
    return packed(tokens, wide, **options)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def digest(documents: DataFrame) -> DataFrame:
    return pack_documents(documents.select("doc_id", "text"), tokenizer_path())
