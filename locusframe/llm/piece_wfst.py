r"""SentencePiece encoding and decoding by weighted finite-state transducers.

A model file is compiled into three transducers: the normaliser (a space becomes U+2581, and one is put before a text), the pieces (a
trie of their characters; an arc gives a piece's id and its weight) and the byte fallback (a character that no piece has gives the
pieces of its UTF-8 bytes). Composing them with a text gives a lattice over its characters, whose shortest path in the tropical semiring
is the encoding. For a unigram model an arc's weight is the piece's negative score. For a BPE model arcs also compose with an acceptor
of neighbours: piece b may follow piece a if merging a's and b's characters by the model's scores gives a and b again, and else has
infinite weight. Of all paths that it leaves, exactly one spells the text, the one that merging gives, so at each place of the
lattice one last piece stays. Acceptor arcs are made when first met, and kept.

Where no piece has two characters side by side, no path crosses; texts are cut there, in bulk, and each distinct part is composed once per
worker while it stays in the arena. Parts follow each other in a text, and so do their paths.

Defined cases: null and empty texts have no pieces and decode to an empty text; U+2581 in a text decodes to a space; bytes that aren't
UTF-8 decode to U+FFFD; repeated rows repeat; an empty table gives an empty result; other columns aren't read. Models whose normaliser
has a character map, that take extra white space away or have user-defined pieces raise ValueError: none such is at hand.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arena import Arena
from .words import _BASE, _BYTE, buffers, mix, sliced

SPACE = "▁"
NORMAL, UNKNOWN, BYTE = 1, 2, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        out |= (b[i] & 127) << shift
        shift, i = shift + 7, i + 1
        if b[i - 1] < 128:
            return out, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        if key & 7 == 0:
            value, i = _varint(b, i)
        else:
            n, i = _varint(b, i) if key & 7 == 2 else ((4, i) if key & 7 == 5 else (8, i))
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Transducer:
    def __init__(self, model: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        kinds, self.bpe, self.prefix = [], False, True
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                self.pieces.append(f[1].decode())
                self.scores.append(float(np.frombuffer(f.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(f.get(3, NORMAL))
            elif number == 2:
                kind = dict(_fields(value)).get(3, 1)
                if kind not in (1, 2):
                    raise ValueError("only unigram and BPE models are supported")
                self.bpe = kind == 2
            elif number == 3:
                f = dict(_fields(value))
                self.prefix = bool(f.get(3, 1))
                if f.get(2) or f.get(4, 1) or not f.get(5, 1):
                    raise ValueError("only identity normalisers are supported")
        if 4 in kinds:
            raise ValueError("user-defined pieces are not supported")
        self.unknown = kinds.index(UNKNOWN)
        self.id = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == NORMAL}
        self.byte = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == BYTE}
        self.longest = max(map(len, self.id))
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else p.encode() if k == NORMAL else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self.bytes_of[self.unknown] = " ⁇ ".encode()
        # which bytes may stand side by side within a path; of other than ASCII any
        self.joined = np.ones((256, 256), bool)
        self.joined[:128, :128] = False
        for p in self.id:
            p = p.replace(SPACE, " ")
            for a, b in zip(p, p[1:]):
                if a < "\x80" and b < "\x80":
                    self.joined[ord(a), ord(b)] = True
        self.follows: dict[tuple[int, int], bool] = {}
        self.arena = Arena(self.paths)

    def merged(self, chars: str) -> list[str]:
        """What merging by score makes of a short string."""
        s = list(chars)
        while True:
            best, at = None, -1
            for i in range(len(s) - 1):
                k = self.id.get(s[i] + s[i + 1])
                if k is not None and (best is None or self.scores[k] > best):
                    best, at = self.scores[k], i
            if at < 0:
                return s
            s[at : at + 2] = [s[at] + s[at + 1]]

    def may_follow(self, a: int, b: int) -> bool:
        found = self.follows.get((a, b))
        if found is None:
            if len(self.follows) > 2_000_000:
                self.follows.clear()
            x, y = self.pieces[a], self.pieces[b]
            found = self.follows[a, b] = self.merged(x + y) == [x, y]
        return found

    def fallback(self, char: str) -> list[int]:
        return [self.byte[b] for b in char.encode()] if self.byte else [self.unknown]

    def path(self, part: str) -> list[int]:
        """Ids of the shortest path through the lattice of a part, spaces being U+2581."""
        n, get = len(part), self.id.get
        if (whole := get(part)) is not None and (n == 1 or self.bpe and self.merged(part) == [part]):
            return [whole]
        far = float("inf")
        cost, last, back = [far] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        cost[0] = 0.0
        for i in range(n):
            if cost[i] == far:
                continue
            before, any_arc = last[i], False
            for j in range(i + 1, min(n, i + self.longest) + 1):
                k = get(part[i:j])
                if k is None:
                    continue
                any_arc |= j == i + 1
                if self.bpe:
                    if cost[j] < far or i and before >= 0 and not self.may_follow(before, k) or (j - i > 1 and not self.may_stand(k)):
                        continue
                    cost[j], last[j], back[j] = cost[i] + 1.0, k, i
                elif cost[i] - self.scores[k] < cost[j]:
                    cost[j], last[j], back[j] = cost[i] - self.scores[k], k, i
            if not any_arc and cost[i + 1] == far:
                cost[i + 1], last[i + 1], back[i + 1] = cost[i] + 1e3, -2, i
        out, j = [], n
        while j:
            i = back[j]
            out.append([last[j]] if last[j] >= 0 else self.fallback(part[i]))
            j = i
        return [x for ids in reversed(out) for x in ids]

    def may_stand(self, k: int) -> bool:
        """Merging a piece's own characters gives the piece."""
        found = self.follows.get((k, -1))
        if found is None:
            found = self.follows[k, -1] = self.merged(self.pieces[k]) == [self.pieces[k]]
        return found

    def paths(self, parts: list[bytes]) -> list[list[int]]:
        return [self.path(p.decode().replace(" ", SPACE)) for p in parts]

    def texts(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and where each begins."""
        data, offs = buffers(column)
        full = np.diff(offs) > 0
        if self.prefix:
            data = np.insert(data, offs[:-1][full], 32)
            offs = offs + np.concatenate([[0], np.cumsum(full)])
        n = len(data)
        if not n:
            return np.empty(0, np.uint32), np.zeros(len(offs), np.int64)
        cut = np.ones(n + 1, bool)
        cut[1:n] = ~self.joined[data[:-1], data[1:]]
        cut[offs] = True
        bounds = np.flatnonzero(cut)
        starts, ends = bounds[:-1], bounds[1:]
        ids, lens = self.arena.expanded(data.tobytes(), starts, ends, _hashes(data, starts, ends))
        return ids, np.concatenate([[0], np.cumsum(lens)])[np.searchsorted(starts, offs)]

    def text(self, ids: np.ndarray) -> str:
        out = b"".join([self.bytes_of[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return out[1:] if self.prefix and out[:1] == " " else out


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each part; parts cover all bytes."""
    lens = ends - starts
    inner = np.arange(len(data)) - np.repeat(starts, lens)
    powers = np.cumprod(np.full(int(lens.max()), _BASE, np.uint64))
    return mix(np.add.reduceat(_BYTE[data] * powers[inner], starts) + lens.astype(np.uint64))


@lru_cache(2)
def _loaded(model: bytes) -> Transducer:
    return Transducer(model)


def _wide(model: bytes) -> int:
    return 2 if len(_loaded(model).pieces) < 1 << 16 else 4


def encoded(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """doc_id, n_pieces, ids (binary: little-endian, 2 bytes an id if the vocabulary allows it, else 4), and the text if asked for. The
    model is read on the driver and sent along (half a MB), so executors need no copy."""
    with open(path, "rb") as f:
        model = f.read()
    wide = _wide(model)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _loaded(shared.value)
        for b in sliced(batches, "text"):
            ids, first = fst.texts(b.column(1))
            binary = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((first * wide).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(ids, f"<u{wide}"))]).cast(pa.binary())
            cols = [b.column(0), pa.array(np.diff(first).astype(np.int64)), binary] + [b.column(1)] * keep_text
            yield pa.RecordBatch.from_arrays(cols, names=[x.name for x in schema])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_pieces", T.LongType()), T.StructField("ids", T.BinaryType()), *([T.StructField("text", T.StringType())] if keep_text else [])])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


def decoded(pieces: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """pieces with the text of `ids` in `decoded` (null ids: null); other columns pass unchanged."""
    with open(path, "rb") as f:
        model = f.read()
    wide = _wide(model)
    shared = pieces.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in pieces.schema if f.name != "decoded"]
    at = [f.name for f in kept].index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = _loaded(shared.value)
        for b in sliced(batches, ids):
            texts = [None if x is None else fst.text(np.frombuffer(x, f"<u{wide}")) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*(f.name for f in kept), "decoded"])

    return pieces.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(run, T.StructType([*kept, T.StructField("decoded", T.StringType())]))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def digest(documents: DataFrame) -> DataFrame:
    """doc_id, n_pieces, digests of ids and of the decoded text, and whether that equals the text."""
    t = decoded(encoded(documents.select("doc_id", "text"), model_path(), keep_text=True), model_path())
    return t.select("doc_id", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"))
