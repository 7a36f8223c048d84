"""Reading VCF files: plain text, gzip and BGZF, told apart by content."""

from __future__ import annotations

import os
import sys
import tempfile
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.header import VcfError, VcfHeader
from locusframe.operators.frame import VcfFrame, split_lines
from locusframe.sources import bgzf

_HEAD_LIMIT = 64 << 20


def _local(path: str) -> str | None:
    """The path on this machine, if it is one."""
    plain = path.removeprefix("file://")
    return plain if "://" not in plain and os.path.exists(plain) else None


def _chunks(spark: SparkSession, path: str, size: int = 1 << 16) -> Iterator[bytes]:
    """The file's bytes from its start, wherever it is."""
    if (own := _local(path)) is not None:
        with open(own, "rb") as f:
            while b := f.read(size):
                yield b
        return
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = there.getFileSystem(spark._jsc.hadoopConfiguration()).open(there)
    try:
        while b := bytes(stream.readNBytes(size)):
            yield b
    finally:
        stream.close()


def _inflated(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Contents of any number of gzip members."""
    d, held = zlib.decompressobj(31), b""
    for held in chunks:
        while held:
            yield d.decompress(held)
            held = d.unused_data
            if held or d.eof:
                d = zlib.decompressobj(31)


def read_header(spark: SparkSession, path: str) -> tuple[VcfHeader, list[str], str]:
    """The header, its lines, and the file's kind. Only the head of the file is read."""
    chunks = _chunks(spark, path)
    first = next(chunks, b"")
    kind = bgzf.sniff(first[:64])

    def again() -> Iterator[bytes]:
        yield first
        yield from chunks

    lines, held, size = [], b"", 0
    for text in again() if kind == "plain" else _inflated(again()):
        held += text
        size += len(text)
        *whole, held = held.split(b"\n")
        for x in whole:
            lines.append(x.removesuffix(b"\r").decode("utf-8", "replace"))
            if lines[-1].startswith("#CHROM") or lines[-1] and not lines[-1].startswith("#"):
                return VcfHeader.parse(lines), lines, kind
        if size > _HEAD_LIMIT:
            raise VcfError(f"{path}: the header is too long")
    lines.append(held.removesuffix(b"\r").decode("utf-8", "replace"))
    return VcfHeader.parse(lines), lines, kind


def read_lines(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """block, mid, value of each line, header and all; a carriage return at a line's end is not part of it."""
    own = _local(path)
    if kind == "bgzf" and own is not None:
        spark.dataSource.register(bgzf.BgzfSource)
        return spark.read.format("bgzf").option("path", own).load()
    if kind != "plain" and not path.endswith(".gz"):
        if own is None:
            raise VcfError(f"{path}: compressed files elsewhere than on this machine need the suffix .gz")
        link = os.path.join(tempfile.mkdtemp(prefix="locusframe-"), "input.gz")
        os.symlink(os.path.abspath(own), link)
        path = link
    t = spark.read.option("lineSep", "\n").text(path)
    return t.select(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("mid"), F.regexp_replace("value", "\r$", "").alias("value"))


def read_vcf(spark: SparkSession, path: str, file_idx: int = 0) -> VcfFrame:
    """A frame of one file (`-` is standard input, which is spooled). Lines of the header are left out by their text, so a comment
    line in the body stays unless it repeats one of them."""
    if path == "-":
        with tempfile.NamedTemporaryFile(prefix="locusframe-", delete=False) as f:
            while b := sys.stdin.buffer.read(1 << 20):
                f.write(b)
        path = f.name
    header, lines, kind = read_header(spark, path)
    t = read_lines(spark, path, kind)
    head = [x for x in dict.fromkeys(lines) if x.startswith("#")]
    t = t.filter(~(F.col("value").startswith("#") & F.col("value").isin(head))).withColumn("file_idx", F.lit(file_idx))
    return VcfFrame(header, split_lines(t), True)


def file_list(positional: list[str], listing: str | None = None) -> list[str]:
    """Inputs named one by one, then those in a list file (blank and # lines don't count)."""
    out = list(positional)
    if listing:
        with open(listing, encoding="utf-8") as f:
            out += [x.strip() for x in f if x.strip() and not x.strip().startswith("#")]
    return out
