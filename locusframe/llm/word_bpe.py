"""Token ids of whole texts by a public word-level BPE tokenizer (a `tokenizers` JSON file).

The tokenizer drops white space, so the ids of a text are those of its words, one after the other. Words are hashed in bulk, and each
distinct word is encoded once per worker. A word of ASCII or Latin-1 letters takes the merges only, run by tiktoken over ranks that
equal the file's merges (the end-of-word mark is the byte 0xFF, which UTF-8 never has); any other word goes through the file's
tokenizer itself. Files whose merges aren't their vocabulary's order, or with other pre-tokenization, go through it altogether.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .arena import Arena
from .words import Words, sliced

MARK = "</w>"
_PLAIN = regex.compile(r"[\x21-\x7eÀ-ÿ]+")


def _bytes_of() -> dict[str, int]:
    """Bytes by the characters that stand for them in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class WordBpe:
    def __init__(self, spec: str):
        self.whole = Tokenizer.from_str(spec)
        j = json.loads(spec)
        vocab, merges = j["model"]["vocab"], j["model"]["merges"]
        self.size = max([*vocab.values(), *(a["id"] for a in j["added_tokens"])]) + 1
        split = next((p for p in j["pre_tokenizer"].get("pretokenizers", []) if p["type"] == "Split" and p["behavior"] == "Removed" and p["invert"]), None)
        kinds = [n["type"] for n in (j["normalizer"] or {}).get("normalizers", [])]
        names = [m if isinstance(m, str) else " ".join(m) for m in merges]
        ordered = all(vocab.get(m.replace(" ", "")) == vocab[names[0].replace(" ", "")] + i for i, m in enumerate(names))
        self.fast = None
        if split and ordered and kinds == ["NFC", "Replace", "Lowercase"] and j["model"]["end_of_word_suffix"] == MARK and not j["model"].get("ignore_merges"):
            of = _bytes_of()
            ranks = {}
            for s, i in vocab.items():
                end = s.endswith(MARK) and s != MARK
                core = s[: -len(MARK)] if end else s
                if all(c in of for c in core):
                    ranks[bytes(of[c] for c in core) + b"\xff" * end] = i
            self.pattern = regex.compile(split["pattern"]["Regex"])
            self.fast = tiktoken.Encoding("word", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.arena = Arena(self.encode)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word."""
        out: list = [None] * len(words)
        rest, texts = [], []
        for i, w in enumerate(words):
            s = w.decode()
            if self.fast is not None and _PLAIN.fullmatch(s) and "<|" not in s:
                s = s.lower()
                if s.isalpha():
                    out[i] = self.fast.encode_single_piece(s.encode() + b"\xff")
                else:
                    out[i] = [x for part in self.pattern.findall(s) for x in self.fast.encode_single_piece(part.encode() + b"\xff")]
            else:
                rest.append(i)
                texts.append(s)
        for i, e in zip(rest, self.whole.encode_batch(texts, add_special_tokens=False) if texts else [], strict=True):
            out[i] = e.ids
        return out

    def texts(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each closed by `end`, and where each begins."""
        w = Words(column)
        ids, lens = self.arena.expanded(w.data.tobytes(), w.starts, w.ends, w.hashes())
        ahead = np.concatenate([[0], np.cumsum(lens)])[w.first]
        out = np.insert(ids, ahead[1:], np.uint32(end))
        return out, ahead + np.arange(len(ahead))


@lru_cache(2)
def _loaded(spec: str) -> WordBpe:
    return WordBpe(spec)


def forget() -> None:
    """Drops the loaded tokenizers of this process."""
    _loaded.cache_clear()


def tokenized(docs: DataFrame, path: str, end: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian, 2 bytes an id if the vocabulary allows it, else 4). Null text is empty. The file is
    read on the driver and sent along (a few MB whatever the input), so executors need no copy."""
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    wide = width(spec)
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(shared.value)
        for b in sliced(batches, "text"):
            ids, first = bpe.texts(b.column(1), end)
            flat = np.ascontiguousarray(ids, f"<u{wide}")
            binary = pa.Array.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer((first * wide).astype(np.int64)), pa.py_buffer(flat)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(first).astype(np.int64)), binary.cast(pa.binary())], names=["doc_id", "n_tokens", "ids"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)


@lru_cache(2)
def width(spec: str) -> int:
    """Bytes that an id takes."""
    j = json.loads(spec)
    return 2 if max([*j["model"]["vocab"].values(), *(a["id"] for a in j["added_tokens"])]) < 1 << 16 else 4
