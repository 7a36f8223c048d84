"""Writing variant tables in order: one file, plain or BGZF, or a directory of parts; and the byte-level concatenation."""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.header import VcfError
from locusframe.operators.frame import VcfFrame
from locusframe.sources import bgzf
from locusframe.sources.reader import read_header


def output_kind(letter: str | None, path: str | None) -> str:
    """plain or bgzf, of v, u, z or b, else by the path's suffix."""
    if letter is None:
        return "bgzf" if path and path.endswith((".gz", ".bgz")) else "plain"
    if letter not in "vuzb" or len(letter) != 1:
        raise VcfError(f"unknown output type '{letter}'")
    return "bgzf" if letter in "zb" else "plain"


def check_codec(codec: str, level: int) -> None:
    if codec not in ("lib", "rust"):
        raise VcfError(f"unknown codec '{codec}'")
    if not 0 <= level <= 12 or codec == "rust" and level > 6:
        raise VcfError(f"codec '{codec}' has no level {level}")


def _sorted(frame: VcfFrame) -> DataFrame:
    return frame.lines().orderBy(*frame.order).select("value")


def packed(lines: DataFrame, level: int | None) -> DataFrame:
    """Lines as bytes, in the order of partitions: plain, or BGZF blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def text() -> Iterator[bytes]:
            for b in batches:
                for part in range(0, b.num_rows, 1024):
                    yield "".join(x + "\n" for x in b.column(0).slice(part, 1024).to_pylist()).encode()

        for piece in text() if level is None else bgzf.blocks(text(), level):
            yield pa.RecordBatch.from_arrays([pa.array([piece], pa.binary())], names=["data"])

    return lines.mapInArrow(run, "data binary")


def inflated_lines(data: DataFrame) -> DataFrame:
    """Lines of partitions of BGZF blocks, each block a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = b""
        for b in batches:
            for x in b.column(0).to_pylist():
                *lines, held = (held + bgzf.inflate(x)).split(b"\n")
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary()).cast(pa.string())], names=["value"])

    return data.mapInArrow(run, "value string")


def write_vcf(frame: VcfFrame, path: str | None = None, kind: str = "plain", level: int = 6, header: bool = True, header_only: bool = False) -> None:
    """One ordered file (None: standard output). Partitions are compressed where they are and come to the driver one after the other, so
    its memory holds one partition at most. A reader that closes the pipe ends the output without an error."""
    out: BinaryIO = sys.stdout.buffer if path is None else open(path, "wb")  # noqa: SIM115
    try:
        head = frame.header.text(drop_genotypes=not frame.header.samples and not frame.header.has_format).encode() if header else b""
        if kind == "bgzf":
            for b in bgzf.blocks(iter([head]), level):
                out.write(b)
        else:
            out.write(head)
        if not header_only:
            for row in packed(_sorted(frame), level if kind == "bgzf" else None).toLocalIterator():
                out.write(row["data"])
        if kind == "bgzf":
            out.write(bgzf.EOF_BLOCK)
        out.flush()
    except BrokenPipeError:
        sys.stdout = open(os.devnull, "w")  # noqa: SIM115
    finally:
        if path is not None:
            out.close()


def write_parts(frame: VcfFrame, path: str) -> None:
    """A directory: header.txt holds the header, the parts in the order of their names the records. Nothing passes the driver but the header."""
    spark = frame.df.sparkSession
    _sorted(frame).write.mode("overwrite").text(path)
    head = frame.header.text().rstrip("\n")
    spark.range(1).select(F.lit(head).alias("value")).coalesce(1).write.mode("overwrite").text(f"{path}/_header")


def concat_bytes(spark: SparkSession, paths: list[str], out: str) -> None:
    """BGZF files with the same header, joined without decoding their bodies: only a block that holds the header's end is made anew."""
    first: str | None = None
    with open(out, "wb") as f:
        for path in paths:
            with open(path, "rb") as g:
                if bgzf.sniff(g.read(64)) != "bgzf":
                    raise VcfError(f"{path}: only BGZF files can be joined as they are")
            header, lines, _ = read_header(spark, path)
            text = "\n".join(lines) + "\n"
            if first is not None and text != first:
                raise VcfError(f"{path}: its header differs from the first")
            left, first_file, first = len(text.encode()), first is None, text
            start = None
            for at, data in bgzf.read_blocks(path):
                if left > len(data):
                    left -= len(data)
                    if first_file:
                        f.write(bgzf.deflate(data))
                    continue
                for piece in ([data[:left]] if first_file else []) + [data[left:]]:
                    for b in bgzf.blocks(iter([piece])):
                        f.write(b)
                start = at
                break
            ends = bgzf.offsets(path)
            k = ends.index(start) + 1 if start is not None else len(ends) - 1
            with open(path, "rb") as g:
                for a, z in zip(ends[k:-1], ends[k + 1 :], strict=True):
                    g.seek(a)
                    block = g.read(z - a)
                    if block != bgzf.EOF_BLOCK:
                        f.write(block)
        f.write(bgzf.EOF_BLOCK)
