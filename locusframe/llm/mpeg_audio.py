"""Media column: MPEG audio.

`probe` reads any MPEG-1, 2 or 2.5 stream (layers I to III): it skips ID3v2 and ID3v1 tags, resynchronises on frame headers (a
header counts if the frame that it announces ends at another header, a tag or the end), reads the Xing/Info table of variable
bitrates with its seek table, verifies the CRC-16 of protected layer III frames and of the encoder's tag, and gives exact
durations (samples over the sample rate) and the byte offset of every frame.

`pack` stores bytes losslessly in a silent MPEG-1 layer III stream: 48 kHz, mono, protected frames whose main data are the payload.
All frames have 320 kbit/s but the last, which has the least bitrate that holds the rest, so the stream has a variable bitrate and
carries a Xing table. The payload's length and CRC-32 stand in an ID3v2 tag; unpacking checks both.

Defined cases: null text is an empty text; an empty text is stored as 64 zero bytes; null media give null features; bytes without
any frame give zero frames, a duration of zero and all bytes as junk. Rows are independent: repeated rows give repeated results, an
empty table an empty one, and other columns pass unchanged (a column of the output's name is replaced).
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from math import gcd

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import sliced

# Fixed values of the MPEG audio standards: kbit/s by (version is 1, layer) and index, Hz by version and index.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HZ = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
VERSIONS = {0: 2.5, 2: 2.0, 3: 1.0}

SIDE = 17  # bytes of side information of a mono MPEG-1 layer III frame
BLOCK = 64


def _table(poly: int, reflected: bool) -> list[int]:
    out = []
    for b in range(256):
        r = b if reflected else b << 8
        for _ in range(8):
            r = (r >> 1) ^ poly if reflected and r & 1 else r >> 1 if reflected else ((r << 1) ^ poly if r & 0x8000 else r << 1) & 0xFFFF
        out.append(r)
    return out


_CRC, _CRC_TAG = _table(0x8005, False), _table(0xA001, True)


@lru_cache(65536)
def frame_crc(covered: bytes) -> int:
    """CRC-16 of the header's last two bytes and the side information."""
    r = 0xFFFF
    for b in covered:
        r = (r << 8 & 0xFFFF) ^ _CRC[r >> 8 ^ b]
    return r


def tag_crc(covered: bytes) -> int:
    """CRC-16 of an encoder's tag."""
    r = 0
    for b in covered:
        r = r >> 8 ^ _CRC_TAG[(r ^ b) & 255]
    return r


@lru_cache(65536)
def header(four: bytes) -> tuple | None:
    """(bytes, samples, Hz, kbit/s, version, layer, protected, side bytes) that a frame header announces, or None."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = VERSIONS.get(four[1] >> 3 & 3), 4 - (four[1] >> 1 & 3)
    rate, hz, pad = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version is None or layer == 4 or rate in (0, 15) or hz == 3 or four[3] & 3 == 2:
        return None
    kbps, hz = KBPS[version == 1, layer][rate], HZ[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12 * kbps * 1000 // hz + pad) * 4 if layer == 1 else samples // 8 * kbps * 1000 // hz + pad
    mono = four[3] >> 6 == 3
    side = 0 if layer < 3 else (17 if mono else 32) if version == 1 else (9 if mono else 17)
    return size, samples, hz, kbps, version, layer, not four[1] & 1, side


def syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def id3(data: bytes, at: int) -> tuple[int, dict[str, str]]:
    """Length of the ID3v2 tag at `at` (0: none) and its text fields."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return 0, {}
    end, k, fields = at + 10 + syncsafe(data[at + 6 : at + 10]), at + 10, {}
    safe = data[at + 3] >= 4
    while k + 10 <= min(end, len(data)) and data[k : k + 4].isalnum():
        n = syncsafe(data[k + 4 : k + 8]) if safe else struct.unpack(">I", data[k + 4 : k + 8])[0]
        name, body = data[k : k + 4].decode("latin-1"), data[k + 10 : min(k + 10 + n, end)]
        if name[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[min(body[0], 3)], "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            fields.setdefault(key, value)
        k += 10 + n
    return min(end, len(data)) - at, fields


def xing(frame: bytes, side: int) -> dict | None:
    """The table of variable bitrates in a first frame."""
    for skip in (4 + side, 6 + side):
        if frame[skip : skip + 4] in (b"Xing", b"Info"):
            break
    else:
        return None
    flags, k = struct.unpack(">I", frame[skip + 4 : skip + 8])[0], skip + 8
    out: dict = {"kind": frame[skip : skip + 4].decode(), "frames": None, "bytes": None, "toc": None, "tag_crc_ok": None}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit and len(frame) >= k + 4:
            out[name] = struct.unpack(">I", frame[k : k + 4])[0]
            k += 4
    if flags & 4:
        out["toc"], k = list(frame[k : k + 100]), k + 100
    k += 4 * bool(flags & 8)
    if len(frame) >= k + 36 and frame[k : k + 9].strip(b"\0"):
        out["tag_crc_ok"] = tag_crc(frame[: k + 34]) == struct.unpack(">H", frame[k + 34 : k + 36])[0]
    return out


def probe(data: bytes) -> dict:
    """What a stream holds; see above. `audio` has (offset, header) of each frame, the table's frame not among them."""
    at, tags, end = 0, {}, len(data)
    while n := id3(data, at)[0]:
        tags |= id3(data, at)[1]
        at += n
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        tags.setdefault("id3v1_title", data[end + 3 : end + 33].split(b"\0")[0].decode("latin-1"))
    audio, junk, resyncs, bad, table, lost = [], 0, 0, 0, None, False
    while at < end:
        if data.startswith(b"ID3", at) and (n := id3(data, at)[0]):  # a tag between frames, as where streams were joined
            tags, at = id3(data, at)[1] | tags, at + n
            continue
        h = header(data[at : at + 4])
        fits = h and at + h[0] <= end
        if fits and (lost or not audio and table is None):  # unconfirmed until the next frame or the end follows
            fits = at + h[0] == end or header(data[at + h[0] : at + h[0] + 4]) is not None
        if not fits:
            skip = min(x if x >= 0 else end for x in (data.find(b"\xff", at + 1, end), data.find(b"ID3", at + 1, end)))
            junk, resyncs, lost, at = junk + skip - at, resyncs + (not lost), True, skip
            continue
        lost = False
        if not audio and table is None and (table := xing(data[at : at + h[0]], h[7])):
            at += h[0]
            continue
        if h[6] and h[5] == 3:
            bad += frame_crc(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h[7]]) != data[at + 4] << 8 | data[at + 5]
        audio.append((at, h))
        at += h[0]
    samples: dict[int, int] = {}
    for _, h in audio:
        samples[h[2]] = samples.get(h[2], 0) + h[1]
    num, den = 0, 1
    for hz, n in sorted(samples.items()):  # the exact sum of samples over rates
        num, den = num * hz + n * den, den * hz
        g = gcd(num, den) or 1
        num, den = num // g, den // g
    return {"tags": tags, "table": table, "audio": audio, "junk_bytes": junk, "resyncs": resyncs, "bad_checksums": bad, "duration_num": num, "duration_den": den}


def _shell(kbps_index: int, protected: bool = True) -> bytes:
    two = bytes([kbps_index << 4 | 1 << 2, 0xC4])
    head = bytes([0xFF, 0xFA if protected else 0xFB]) + two
    return head + (struct.pack(">H", frame_crc(two + bytes(SIDE))) if protected else b"") + bytes(SIDE)


_FULL = _shell(14)
_ROOM = 960 - len(_FULL)  # 320 kbit/s at 48 kHz: 960 bytes
_LAST = [(3 * k - len(_FULL), _shell(i)) for i, k in enumerate(KBPS[True, 3]) if i]


def pack(payload: bytes) -> bytes:
    """The payload as an MPEG audio stream."""
    whole, rest = divmod(len(payload), _ROOM)
    frames = [_FULL + payload[k * _ROOM : (k + 1) * _ROOM] for k in range(whole)]
    if rest or not whole:
        room, shell = next(x for x in _LAST if x[0] >= rest)
        frames.append((shell + payload[whole * _ROOM :]).ljust(room + len(shell), b"\0"))
    size = sum(map(len, frames))
    n = len(frames)
    first = _shell(14, protected=False)
    total = size + 960
    toc = bytes(min(255, (960 + 960 * (n * p // 100)) * 256 // total) for p in range(100))
    first += b"Xing" + struct.pack(">III", 15, n, total) + toc + struct.pack(">I", 0)
    first += b"locusframe"[:9] + bytes([0x10, 200]) + bytes(8) + bytes([0, 32]) + bytes(3) + bytes(2) + bytes(2) + struct.pack(">I", total) + bytes(2)
    first = (first + struct.pack(">H", tag_crc(first))).ljust(960, b"\0")
    body = b"".join(b"TXXX" + struct.pack(">I", len(x)) + b"\0\0" + x for x in (b"\0payload_bytes\0%d" % len(payload), b"\0payload_crc32\0%08x" % zlib.crc32(payload)))
    n = len(body)
    return b"ID3\x03\0\0" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body + first + b"".join(frames)


def unpack(data: bytes, found: dict | None = None) -> bytes:
    """The payload of a stream that `pack` made. Raises ValueError if its length or a checksum is wrong."""
    found = found or probe(data)
    out = b"".join([data[at + 6 + h[7] : at + h[0]] for at, h in found["audio"]])
    n = int(found["tags"].get("payload_bytes", -1))
    out = out[:n] if n >= 0 else b""
    if found["bad_checksums"] or len(out) != n or f"{zlib.crc32(out):08x}" != found["tags"].get("payload_crc32"):
        raise ValueError("the stream's payload is damaged")
    return out


def with_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Adds the column `media`: the text as UTF-8, zero bytes up to a positive multiple of 64, packed."""
    schema = T.StructType([*(f for f in df.schema if f.name != media), T.StructField(media, T.BinaryType())])
    keep = [f.name for f in schema][:-1]
    out = df.select(*[F.col(f"`{c}`") for c in keep])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, text, 8 << 20):
            made = []
            for x in b.column(keep.index(text)).cast(pa.binary()).to_pylist():
                x = x or b""
                made.append(pack(x.ljust(max(BLOCK, -(-len(x) // BLOCK) * BLOCK), b"\0")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], names=[*keep, media])

    return out.mapInArrow(run, schema)


FEATURES = T.StructType([
    T.StructField("payload", T.BinaryType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("n_frames", T.LongType()),
    T.StructField("duration_num", T.LongType()), T.StructField("duration_den", T.LongType()), T.StructField("frame_offsets", T.ArrayType(T.LongType())),
    T.StructField("bad_checksums", T.LongType()), T.StructField("junk_bytes", T.LongType()), T.StructField("feature", T.StringType()),
])


def with_features(df: DataFrame, media: str = "media", keep_media: bool = False) -> DataFrame:
    """Reads each stream back: payload (null where `pack` didn't make it or it is damaged), exact duration, seek offsets, checksums."""
    names = {f.name for f in FEATURES}
    kept = [f for f in df.schema if f.name not in names and (keep_media or f.name != media)]
    out = df.select(*[F.col(f"`{f.name}`") for f in kept if f.name != media], F.col(f"`{media}`").alias("__media"))
    order = [f for f in kept if f.name != media] + [f for f in kept if f.name == media]
    schema = T.StructType([*order, *FEATURES])
    arrow = [pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]

    def features(x: bytes | None) -> tuple:
        if x is None:
            return (None,) * len(FEATURES)
        found = probe(x)
        try:
            payload = unpack(x, found)
        except ValueError:
            payload = None
        offsets = [at for at, _ in found["audio"]]
        rates = sorted({h[3] for _, h in found["audio"]})
        said = {"frames": len(offsets), "duration": f"{found['duration_num']}/{found['duration_den']}", "kbps": rates, "vbr": len(rates) > 1, "table": (found["table"] or {}).get("kind"), "offsets_crc32": zlib.crc32(struct.pack(f"<{len(offsets)}q", *offsets)), "bad_checksums": found["bad_checksums"]}
        return payload, len(x), hashlib.sha256(x).hexdigest(), len(offsets), found["duration_num"], found["duration_den"], offsets, found["bad_checksums"], found["junk_bytes"], json.dumps(said, sort_keys=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, "__media", 8 << 20):
            rows = [features(x) for x in b.column(b.num_columns - 1).to_pylist()]
            cols = list(zip(*rows, strict=True))
            own = list(b.columns[:-1]) + ([b.columns[-1]] if len(order) and order[-1].name == media else [])
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(list(c), t) for c, t in zip(cols, arrow, strict=True))], names=[f.name for f in schema])

    return out.mapInArrow(run, schema)


def digest(df: DataFrame) -> DataFrame:
    """doc_id, n_bytes and what the stored streams give of each document's text. Payload columns come from the bytes read back."""
    t = with_features(with_media(df.select("doc_id", "text")).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).drop("text"))
    return t.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -64, 64)")).alias("tail_crc32"),
        "media_bytes", "media_sha256", "feature", "n_frames", "duration_num", "duration_den",
    )
