r"""MinHash near-duplicates with tensored banding.

A document's set are its distinct word shingles (words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lower-cased). Two small
collections of `half` hashes are computed per set, each of them `rows` minhashes combined; the keys of the half x half tables are all
pairs of one hash from either. half=10 and rows=2 take 40 minhashes where plain banding of as many tables takes 400. A pair of Jaccard
similarity s meets in some table with probability (1 - (1 - s^2)^10)^2: 0.99993 at 0.8, 0.9999997 at 0.87.

What meets is verified on the full sets. Equal sets are one node from the start. In each table key all nodes are compared with one
pivot; what is linked then is one component, and a second pivot follows where a key still holds several. Last, the nodes of each key
that still holds several components are compared across components in blocks of `BLOCK` by `BLOCK`, once per pair (at the first key that
the two share), by bitmaps of their sets: cells that one set has and the other hasn't bound their overlap from above, exactly, so only
pairs within that bound leave the block, to be verified on the full sets. So links are lost to the hashing alone; there is no cap, and no
group is expanded into rows of pairs. Sets travel only for nodes that have a candidate; a Bloom filter of fixed size (2^26 bits) finds
them in a second pass over the texts.

Defined cases: null or wordless texts have an empty set and are linked with nothing; a text of fewer words than a shingle has its
whole sequence as its only shingle. Rows are told apart by their set, not by id: rows that repeat an id with another text have
their own component, equal rows share one. A null id never is a component's id unless its component has no other. An empty table gives
an empty result. Other columns aren't read by `components_of`; `deduplicated` returns them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph, store
from .words import Words, combined, mix, sliced

BLOOM_BITS = 26
BLOCK = 1024
_rng = np.random.Generator(np.random.PCG64(8086))
_A = _rng.integers(1, 2**63, 1024, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, 1024, dtype=np.uint64)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of each row, one row after the other, and where each row begins."""
    w = Words(column, lower=True)
    h = w.hashes()
    grams, first = w.grams(h, n)
    out = []
    for i in range(len(first) - 1):
        a, b = w.first[i], w.first[i + 1]
        if first[i + 1] > first[i]:
            out.append(np.unique(grams[first[i] : first[i + 1]]))
        elif b > a:
            whole = np.uint64(b - a)
            for x in h[a:b]:
                whole = combined(np.array([whole]), np.array([x]))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return np.concatenate(out) if out else np.empty(0, np.uint64), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def _nodes(flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(flat), dtype=np.uint64)])
    return mix((total[first[1:]] - total[first[:-1]]) ^ np.diff(first).astype(np.uint64)).view(np.int64)


def sketches(docs: DataFrame, doc_id: str, text: str, n: int, half: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "text", 1 << 20):
            flat, first = shingle_sets(b.column(1), n)
            size, node = np.diff(first), _nodes(flat, first)
            full = np.flatnonzero(size)
            sides = []
            for side in (0, 1):
                each = []
                for i in range(half):
                    k = (side * half + i) * rows
                    mins = [np.minimum.reduceat(flat * _A[k + r] + _B[k + r], first[:-1][full]) if len(full) else np.empty(0, np.uint64) for r in range(rows)]
                    each.append(combined(*mins).view(np.int64))
                value = np.stack(each, 1).ravel()
                offs = np.concatenate([[0], np.cumsum((size > 0) * half)]).astype(np.int32)
                sides.append(pa.ListArray.from_arrays(pa.array(offs), pa.array(value)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size.astype(np.int64)), pa.array(node), b.column(2), *sides], names=["doc_id", "n_shingles", "node", "said", "l", "r"])

    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{text}`")).alias("said")).mapInArrow(run, "doc_id long, n_shingles long, node long, said long, l array<long>, r array<long>")


def _slot(node: Column, doc_id: Column) -> Column:
    return F.shiftrightunsigned(node, 20).bitwiseXOR(F.coalesce(doc_id, F.lit(-1))).bitwiseAND(F.lit((1 << BLOOM_BITS) - 1))


def _sets_of(docs: DataFrame, doc_id: str, text: str, n: int, wanted: DataFrame) -> DataFrame:
    """(node, shingles, bits) of the wanted (node, doc_id)."""
    slot = _slot(F.col("node"), F.col("doc_id"))
    found = wanted.select(F.shiftright(slot, 6).alias("w"), F.expr("shiftleft(1L, cast(" + f"(shiftrightunsigned(node, 20) ^ coalesce(doc_id, -1L)) & 63" + " as int))").alias("bit")).groupBy("w").agg(F.expr("bit_or(bit)").alias("bits")).toPandas()
    bits = np.zeros(1 << (BLOOM_BITS - 6), np.uint64)  # 8 MB, whatever the input
    bits[found["w"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in sliced(batches, "text", 1 << 20):
            flat, first = shingle_sets(b.column(1), n)
            node = _nodes(flat, first)
            slot = (node.view(np.uint64) >> np.uint64(20) ^ b.column(0).fill_null(-1).to_numpy().view(np.uint64)) & np.uint64((1 << BLOOM_BITS) - 1)
            hit = np.flatnonzero((bits[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool) & (np.diff(first) > 0))
            if len(hit):
                parts = [flat[first[i] : first[i + 1]] for i in hit]
                maps = pa.array([bitmap(p) for p in parts], pa.binary())
                offs = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(hit)), pa.array(node[hit]), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(parts).view(np.int64))), maps], names=["doc_id", "node", "shingles", "bits"])

    found = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "doc_id long, node long, shingles array<long>, bits binary")
    same = (found["node"] == wanted["node"]) & found["doc_id"].eqNullSafe(wanted["doc_id"])
    return found.join(wanted, same, "left_semi").dropDuplicates(["node"]).select("node", "shingles", "bits")


def bitmap(x: np.ndarray) -> bytes:
    """Which cells a set has; there are a power of two of them, four times the set's size at least."""
    cells = 1 << max(8, int(4 * len(x) - 1).bit_length())
    on = np.zeros(cells, bool)
    on[(x & np.uint64(cells - 1)).astype(np.int64)] = True
    return np.packbits(on, bitorder="little").tobytes()


def _within(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, ok: np.ndarray, percent: int) -> np.ndarray:
    """Of the pairs in ok (a row of it for each row of a), those whose overlap can be large enough."""
    out = np.zeros(ok.shape, bool)
    for i in range(len(a)):
        j = np.flatnonzero(ok[i])
        if len(j):
            only_a, only_b = np.bitwise_count(a[i] & ~b[j]).sum(1, dtype=np.int64), np.bitwise_count(b[j] & ~a[i]).sum(1, dtype=np.int64)
            most = np.minimum(na[i] - only_a, nb[j] - only_b)
            out[i, j] = 100 * most >= percent * (na[i] + nb[j] - most)
    return out


def _across(half: int, percent: int):  # noqa: ANN202
    """The function of one pair of blocks: candidate pairs of different components, each at the first key that it shares."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        node, comp, n, block = (t.column(c).to_numpy() for c in ("node", "comp", "n", "block"))
        lo, hi, ij = t.column("lo")[0].as_py(), t.column("hi")[0].as_py(), t.column("ij")[0].as_py()
        left, right = (np.array(t.column(c).to_pylist(), np.int64).reshape(len(node), half) for c in ("l", "r"))
        maps = [np.frombuffer(x, np.uint64) for x in t.column("bits").to_pylist()]
        cells = np.array([len(x) for x in maps])
        found_a, found_b = [], []
        for size in np.unique(cells):  # sets whose sizes allow a link have as many cells or twice as many
            same, twice = np.flatnonzero(cells == size), np.flatnonzero(cells == 2 * size)
            folded = [maps[i][:size] | maps[i][size:] for i in twice]
            at, bits = np.concatenate([same, twice]), np.stack([maps[i] for i in same] + folded)
            # rows: the sets of this size; columns: these and the folded ones
            first = np.flatnonzero(block[at] == lo) if lo != hi else np.arange(len(at))
            other = np.flatnonzero(block[at] == hi) if lo != hi else np.arange(len(at))
            for part in range(0, len(first), 256):
                rows = first[part : part + 256]
                i, j = at[rows], at[other]
                ok = comp[i][:, None] != comp[j][None, :]
                ok &= (rows[:, None] < len(same)) | (other[None, :] < len(same))  # two folded ones meet at their own size
                if lo == hi:
                    ok &= i[:, None] < j[None, :]
                ok &= 100 * np.minimum(n[i][:, None], n[j][None, :]) >= percent * np.maximum(n[i][:, None], n[j][None, :])
                for x, k in ((left, ij // half), (right, ij % half)):
                    for earlier in range(k):
                        ok &= x[i, earlier][:, None] != x[j, earlier][None, :]
                hit = np.nonzero(_within(bits[rows], bits[other], n[i], n[j], ok, percent))
                found_a.append(node[i[hit[0]]])
                found_b.append(node[j[hit[1]]])
        return pa.table([pa.array(np.concatenate(found_a)), pa.array(np.concatenate(found_b))], names=["a", "b"])

    return run


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    t = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb")), "b")
    t = t.select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
    return t.filter(100 * F.col("both") >= percent * (F.col("na") + F.col("nb") - F.col("both"))).select("a", "b")


def _near(na: Column, nb: Column, percent: int) -> Column:
    """Sizes that similar sets can have."""
    return (100 * F.least(na, nb)) >= percent * F.greatest(na, nb)


def components_of(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, half: int = 10, rows: int = 2) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs."""
    sk, own = _labelled(docs, doc_id, text, shingle, percent, half, rows)
    least = own.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    names = own.join(least, "comp").select("node", "component_id")
    out = sk.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(names, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def _labelled(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80, half: int = 10, rows: int = 2) -> tuple[DataFrame, DataFrame]:
    """The sketch of each row, and the component (comp) of each node with the node's least doc_id."""
    sk = store.written(sketches(docs, doc_id, text, shingle, half, rows), "sketches")
    full = sk.filter("n_shingles > 0")
    classes = store.written(full.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("n_shingles").alias("n"), F.first("l").alias("l"), F.first("r").alias("r")), "classes")
    pairs = classes.select("node", "n", "r", F.posexplode("l").alias("i", "lk")).select("node", "n", "i", "lk", F.posexplode("r").alias("j", "rk"))
    keys = pairs.select(F.xxhash64("lk", "rk", F.col("i") * half + F.col("j")).alias("key"), (F.col("i") * half + F.col("j")).alias("ij"), "node")
    several = keys.groupBy("key").agg(F.min("node").alias("pivot"), F.count(F.lit(1)).alias("c")).filter("c > 1").select("key", "pivot")
    members = store.written(keys.join(several, "key"), "members")
    size = classes.select("node", "n")

    met = store.written(members.select("node").distinct().join(classes, "node"), "candidates")
    sets = store.written(_sets_of(docs, doc_id, text, shingle, met.select("node", "doc_id")), "sets")

    def compared(cand: DataFrame) -> DataFrame:
        """Edges among the candidates (a, b)."""
        t = cand.join(size.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(size.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        return _verified(t.filter(_near(F.col("na"), F.col("nb"), percent)).select("a", "b"), sets, percent)

    edges = store.written(compared(members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()), "links")
    labels = graph.components(edges)

    def labelled() -> DataFrame:
        """Members of the keys that hold several components, with their component."""
        t = members.select("key", "ij", "node").join(labels, "node", "left").select("key", "ij", "node", F.coalesce("comp", "node").alias("comp"))
        split = t.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
        return t.join(split, "key")

    open_ = store.written(labelled(), "open")
    turn = F.xxhash64("node", F.lit(2))
    second = open_.groupBy("key").agg(F.min(F.struct(turn.alias("t"), F.col("node").alias("pivot"), F.col("comp").alias("pc"))).alias("p")).select("key", "p.pivot", "p.pc")
    more = compared(open_.join(second, "key").filter("comp <> pc").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct())
    edges = store.written(edges.unionByName(more), "links")
    labels = graph.components(edges)

    # what is left across components
    rest = labelled()
    blocks = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("long").alias("blocks"))
    rest = rest.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rest = rest.join(met.select("node", "n", "l", "r"), "node").join(sets.select("node", "bits"), "node").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumn("lo", F.least("block", "with")).withColumn("hi", F.greatest("block", "with")).drop("with", "blocks")
    last = rest.groupBy("key", "lo", "hi").applyInArrow(_across(half, percent), "a long, b long")
    found = store.written(_verified(last, sets, percent), "links")
    if found.limit(1).count():
        labels = graph.components(edges.unionByName(found))

    return sk, classes.select("node", "doc_id").join(labels, "node", "left").select("node", "doc_id", F.coalesce("comp", "node").alias("comp"))


SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select doc_id, case when len(w) = 0 then [] when len(w) = 1 then [w[1]] else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end as s from w
), e as (select doc_id, len(s) as n, unnest(s) as g from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as k from e a join e b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
l as materialized (select a, b from p where 100 * k >= 80 * (na + nb - k)),
r as (select doc_id as a, doc_id as b from s union select r.a, l.b from r join l on r.b = l.a)
select s.doc_id, cast(len(s.s) as bigint) as n_shingles, m.c as component_id, s.doc_id = m.c as kept
from s join (select a, min(b) as c from r group by a) m on m.a = s.doc_id
"""


def digest(documents: DataFrame) -> DataFrame:
    return components_of(documents, shingle=2)


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options: int) -> DataFrame:
    """The row of docs that is the smallest of each component, all columns: by id, null ids last, then by the text's hash. Rows of an
    empty set stay, but for equal ones (id and text)."""
    sk, own = _labelled(docs, doc_id, text, **options)
    full = sk.filter("n_shingles > 0").join(own.select("node", "comp"), "node")
    least = full.groupBy("comp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "said")).alias("p"))
    kept = least.select(F.col("p.doc_id").alias("__kept"), F.col("p.said").alias("__said")).unionByName(sk.filter("n_shingles = 0").select(F.col("doc_id").alias("__kept"), F.col("said").alias("__said")).distinct())
    same = docs[f"`{doc_id}`"].cast("long").eqNullSafe(F.col("__kept")) & (F.xxhash64(docs[f"`{text}`"]) == F.col("__said"))
    turn = Window.partitionBy("__kept", "__said").orderBy("__kept")
    return docs.join(kept, same).withColumn("__turn", F.row_number().over(turn)).filter("__turn = 1").drop("__kept", "__said", "__turn")
