"""BGZF: gzip members of at most 64 KiB that carry their own size. Block hopping, inflating, framing, and a block-parallel text source."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the format: a block's payload limit, and the empty block that ends a file.
PAYLOAD = 0xFF00
EOF_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")


def block_size(head: bytes) -> int | None:
    """Size of the block that begins with these bytes (18 at least); None if it isn't BGZF."""
    if len(head) < 18 or head[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra, at = struct.unpack("<H", head[10:12])[0], 12
    while at + 4 <= min(12 + extra, len(head)):
        name, n = head[at : at + 2], struct.unpack("<H", head[at + 2 : at + 4])[0]
        if name == b"BC" and n == 2 and at + 6 <= len(head):
            return struct.unpack("<H", head[at + 4 : at + 6])[0] + 1
        at += 4 + n
    return None


def sniff(head: bytes) -> str:
    """bgzf, gzip or plain, by content alone."""
    return "bgzf" if block_size(head) else "gzip" if head[:2] == b"\x1f\x8b" else "plain"


def inflate(block: bytes) -> bytes:
    extra = struct.unpack("<H", block[10:12])[0]
    out = zlib.decompress(block[12 + extra : -8], -15)
    if len(out) != struct.unpack("<I", block[-4:])[0]:
        raise ValueError("a BGZF block has another size than it says")
    return out


def deflate(payload: bytes, level: int = 6) -> bytes:
    """One block."""
    c = zlib.compressobj(min(max(level, 1), 9), zlib.DEFLATED, -15)
    body = c.compress(payload) + c.flush()
    if len(body) + 26 > 65536:
        c = zlib.compressobj(0, zlib.DEFLATED, -15)
        body = c.compress(payload) + c.flush()
    return b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def blocks(text: Iterator[bytes], level: int = 6) -> Iterator[bytes]:
    """Blocks of a stream of bytes, without the one that ends a file."""
    held = bytearray()
    for piece in text:
        held += piece
        while len(held) >= PAYLOAD:
            yield deflate(bytes(held[:PAYLOAD]), level)
            del held[:PAYLOAD]
    if held:
        yield deflate(bytes(held), level)


def offsets(path: str) -> list[int]:
    """Where each block begins, and the file's end."""
    out, at = [], 0
    with open(path, "rb") as f:
        while head := f.read(64):
            n = block_size(head)
            if n is None:
                raise ValueError(f"{path}: no BGZF block at byte {at}")
            out.append(at)
            at += n
            f.seek(at)
    return [*out, at]


def read_blocks(path: str, start: int = 0) -> Iterator[tuple[int, bytes]]:
    """(offset, contents) of the blocks from an offset on."""
    with open(path, "rb") as f:
        f.seek(start)
        while head := f.read(18):
            more = struct.unpack("<H", head[10:12])[0] - 6
            head += f.read(max(more, 0))
            n = block_size(head)
            if n is None:
                raise ValueError(f"{path}: no BGZF block at byte {start}")
            rest = f.read(n - len(head))
            if len(head) + len(rest) < n:
                raise ValueError(f"{path}: truncated block at byte {start}")
            yield start, inflate(head + rest)
            start += n


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Reader(DataSourceReader):
    def __init__(self, path: str, bytes_each: int):
        self.path, self.each = path, bytes_each

    def partitions(self) -> list[InputPartition]:
        at = offsets(self.path)
        cuts = [at[0]] if len(at) > 1 else []
        for x in at[1:-1]:
            if x - cuts[-1] >= self.each:
                cuts.append(x)
        return [_Range(a, b) for a, b in zip(cuts, [*cuts[1:], at[-1]], strict=True)] or [_Range(0, 0)]

    def read(self, part: _Range) -> Iterator[tuple[int, int, str]]:
        """Lines that begin in this range of blocks; the last may end in a later one. A range drops what its predecessor finishes."""
        if part.end <= part.start:
            return
        begun, rest, n = part.start == 0, b"", 0
        for at, text in read_blocks(self.path, part.start):
            past = at >= part.end
            lines = (rest + text).split(b"\n")
            rest = lines.pop()
            for line in lines:
                if not begun:
                    begun = True
                    continue
                yield part.start, n, _text(line)
                n += 1
                if past:
                    return
            if past and not begun:
                return
        if rest and begun:
            yield part.start, n, _text(rest)


def _text(line: bytes) -> str:
    return (line[:-1] if line.endswith(b"\r") else line).decode("utf-8", "replace")


class BgzfSource(DataSource):
    """`spark.read.format("bgzf")`: block, mid and value of each line; option bytes_each is how many compressed bytes a task takes."""

    @classmethod
    def name(cls) -> str:
        return "bgzf"

    def schema(self) -> str:
        return "block long, mid long, value string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _Reader(self.options["path"], int(self.options.get("bytes_each", 8 << 20)))
