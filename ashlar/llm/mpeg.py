"""Media columns: MPEG-1 Layer III audio that carries a payload, and its parser.

``mux`` stores bytes in the ancillary area of valid, silent frames (their side information says
that no main data belongs to the granules), each with its CRC-16, behind an ID3v2 tag that names
the payload's length and an ``Xing`` frame with the variable-bitrate table: frames, bytes and a
table of contents of 100 seek points.  All frames but the last have 320 kbit/s; the last takes
the least bitrate that holds the rest.

``parse`` takes any bytes: it reads ID3v2 and ID3v1 tags, walks frame headers, resynchronises
where they break off (a frame counts after a lost place only if another header, a tag or the end
follows it), verifies the checksum of every protected frame, reads the Xing table, and gives the
exact duration in samples, the offset of each frame for seeking, and the ancillary payload.

Defined results: a null payload is an empty one; media without a single frame has 0 frames and
no payload; damaged stretches are counted as ``lost_bytes`` and their frames left out.  Work is
by record batch, a few MB for each; no row meets another.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from ashlar.llm.common import stored, table

# Fixed values of the format: kbit/s by index and sampling rates, MPEG-1 and MPEG-2/2.5, Layer III.
BITRATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

RATE = 48000
SIDE = 17  # bytes of side information, MPEG-1, one channel
OVERHEAD = 4 + 2 + SIDE
POLY = 0x8005


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        value = np.where(value & 0x8000, (value << 1) ^ POLY, value << 1) & 0xFFFF
    return value.astype(np.uint16)


CRC = _crc_table()
_CRC_LIST = CRC.tolist()


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    for x in data:
        crc = ((crc << 8) & 0xFF00) ^ _CRC_LIST[(crc >> 8) ^ x]
    return crc


def _header(index: int) -> bytes:
    """MPEG-1 Layer III with checksum, 48 kHz, one channel."""
    return bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))


def _frame_size(index: int) -> int:
    return 144 * BITRATES_1[index] * 1000 // RATE


_HEADS = {i: (h := _header(i)) + struct.pack(">H", crc16(h[2:] + bytes(SIDE))) + bytes(SIDE) for i in range(1, 15)}
_ROOM = {i: _frame_size(i) - OVERHEAD for i in range(1, 15)}
_TOP = 14


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def _id3(fields: dict[str, str]) -> bytes:
    body = b""
    for k, v in fields.items():
        text = b"\x00" + k.encode("latin-1") + b"\x00" + v.encode("latin-1")
        body += b"TXXX" + struct.pack(">I", len(text)) + b"\x00\x00" + text
    return b"ID3\x03\x00\x00" + _synchsafe(len(body)) + body


def mux(payload: bytes) -> bytes:
    room, size = _ROOM[_TOP], _frame_size(_TOP)
    full, rest = divmod(len(payload), room)
    frames = np.empty((full, size), dtype=np.uint8)
    if full:
        frames[:, :OVERHEAD] = np.frombuffer(_HEADS[_TOP], dtype=np.uint8)
        frames[:, OVERHEAD:] = np.frombuffer(payload, dtype=np.uint8, count=full * room).reshape(full, room)
    tail = b""
    if rest:
        index = next(i for i in range(1, 15) if _ROOM[i] >= rest)
        tail = _HEADS[index] + payload[full * room :] + bytes(_ROOM[index] - rest)
    n = full + bool(rest)
    xing_index = next(i for i in range(1, 15) if _ROOM[i] >= 120)
    total = _frame_size(xing_index) + full * size + len(tail)
    # seek points: the byte (of 256ths) at which each hundredth of the frames begins
    at = np.arange(100) * n // 100 * size + _frame_size(xing_index)
    toc = np.minimum(at * 256 // total, 255).astype(np.uint8).tobytes()
    xing = b"Xing" + struct.pack(">III", 7, n, total) + toc
    first = _HEADS[xing_index] + xing + bytes(_ROOM[xing_index] - len(xing))
    return _id3({"payload_bytes": str(len(payload))}) + first + frames.tobytes() + tail


@dataclass
class Media:
    tags: dict = field(default_factory=dict)
    xing: dict = field(default_factory=dict)
    offsets: list = field(default_factory=list)
    samples: int = 0
    sample_rate: int = 0
    bitrates: set = field(default_factory=set)
    crc_checked: int = 0
    crc_bad: int = 0
    lost_bytes: int = 0
    resyncs: int = 0
    payload: bytes = b""


_DECODED: dict[bytes, tuple | None] = {}


def decode_header(head: bytes) -> tuple | None:
    """(frame bytes, samples, sampling rate, kbit/s, protected, side bytes), or None."""
    if head in _DECODED:
        return _DECODED[head]
    out = None
    if len(head) == 4 and head[0] == 0xFF and head[1] & 0xE0 == 0xE0:
        version, layer = head[1] >> 3 & 3, head[1] >> 1 & 3
        index, rate = head[2] >> 4, head[2] >> 2 & 3
        if version != 1 and layer == 1 and 0 < index < 15 and rate < 3 and head[3] & 3 != 2:
            kbit = (BITRATES_1 if version == 3 else BITRATES_2)[index]
            hz = RATES[version][rate]
            mono = head[3] >> 6 == 3
            side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
            out = ((144 if version == 3 else 72) * kbit * 1000 // hz + (head[2] >> 1 & 1), 1152 if version == 3 else 576, hz, kbit, not head[1] & 1, side)
    if len(_DECODED) < 65536:
        _DECODED[head] = out
    return out


def _read_id3(data: bytes) -> tuple[int, dict]:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0, {}
    size = sum((x & 0x7F) << s for x, s in zip(data[6:10], (21, 14, 7, 0), strict=True))
    tags, at, end = {}, 10, min(10 + size, len(data))
    while at + 10 <= end and data[at : at + 4].strip(b"\x00"):
        n = struct.unpack(">I", data[at + 4 : at + 8])[0] if data[3] < 4 else sum((x & 0x7F) << s for x, s in zip(data[at + 4 : at + 8], (21, 14, 7, 0), strict=True))
        body, name = data[at + 10 : at + 10 + n], data[at : at + 4].decode("latin-1")
        if name == "TXXX" and body[:1] == b"\x00":
            name, _, body = body[1:].decode("latin-1").partition("\x00")
            tags[name] = body
        elif body[:1] == b"\x00":
            tags[name] = body[1:].decode("latin-1")
        at += 10 + n
    return end, tags


def parse(data: bytes) -> Media:
    out = Media()
    at, out.tags = _read_id3(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.setdefault("id3v1_title", data[end + 3 : end + 33].rstrip(b"\x00 ").decode("latin-1"))
    kept, sure, first = [], True, True
    while at + 4 <= end:
        head = data[at : at + 4]
        found = decode_header(head)
        whole = found is not None and at + found[0] <= end
        if whole and not sure:
            after = at + found[0]
            whole = after == end or decode_header(data[after : after + 4]) is not None
        if not whole:
            if sure:
                out.resyncs += 1
            sure = False
            # the next byte that may begin a header
            jump = data.find(b"\xff", at + 1, end)
            jump = end if jump < 0 else jump
            out.lost_bytes += jump - at
            at = jump
            continue
        sure = True
        size, samples, hz, kbit, protected, side = found
        body = at + 4 + 2 * protected
        good = True
        if protected:
            out.crc_checked += 1
            covered = data[at + 2 : at + 4] + data[body : body + side]
            good = _crc_of(covered) == data[at + 4 : at + 6]
            out.crc_bad += not good
        mark = data[body + side : body + side + 4]
        if first and mark in (b"Xing", b"Info"):
            out.xing = _read_xing(data[body + side : at + size], at)
        else:
            out.offsets.append(at)
            out.samples += samples
            out.bitrates.add(kbit)
            if good:
                kept.append(data[body + side : at + size])
        first = False
        out.sample_rate = hz
        at += size
    out.lost_bytes += max(0, end - at)
    whole = b"".join(kept)
    n = out.tags.get("payload_bytes", "")
    out.payload = whole[: int(n)] if n.isdigit() else whole
    return out


_CRCS: dict[bytes, bytes] = {}


def _crc_of(covered: bytes) -> bytes:
    if (known := _CRCS.get(covered)) is None:
        known = struct.pack(">H", crc16(covered))
        if len(_CRCS) < 65536:
            _CRCS[covered] = known
    return known


def _read_xing(data: bytes, at: int) -> dict:
    flags = struct.unpack(">I", data[4:8])[0]
    out, p = {"at": at}, 8
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = struct.unpack(">I", data[p : p + 4])[0]
            p += 4
    if flags & 4:
        out["toc"] = data[p : p + 100]
    return out


def seek_offset(media: Media, sample: int) -> int:
    """The byte at which the frame with the given sample begins."""
    if not media.offsets:
        raise ValueError("no frames")
    return media.offsets[min(sample // (media.samples // len(media.offsets)), len(media.offsets) - 1)]


def payload_of(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text, those with zeros up to a positive multiple of 64)."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % 64 if raw else 64)


SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_frames long, duration_samples long, sample_rate int, seek_offsets array<long>"
)


def feature_of(m: Media) -> str:
    toc = m.xing.get("toc", b"")
    return (
        f"frames={len(m.offsets)};samples={m.samples};rate={m.sample_rate};kbit={min(m.bitrates, default=0)}-{max(m.bitrates, default=0)};"
        f"crc={m.crc_checked}/{m.crc_bad};lost={m.lost_bytes};resyncs={m.resyncs};xing={m.xing.get('frames', -1)};toc={zlib.crc32(toc):08x}"
    )


def media_columns(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, media binary, n_bytes) for every row of ``docs``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            both = [payload_of(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"].astype("Int64"), "n_bytes": [n for n, _ in both], "media": [mux(p) for _, p in both]})

    return docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{text}` AS text").mapInPandas(run, "doc_id long, n_bytes long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """Parses the stored media column of ``media`` and digests what is read back."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for doc_id, n, data in zip(b["doc_id"], b["n_bytes"], b["media"], strict=True):
                data = bytes(data)
                m = parse(data)
                rows.append(
                    (doc_id, n, len(m.payload), hashlib.sha256(m.payload).hexdigest(), zlib.crc32(m.payload[-64:]), len(data),
                     hashlib.sha256(data).hexdigest(), feature_of(m), len(m.offsets), m.samples, m.sample_rate, m.offsets)
                )
            out = pd.DataFrame(rows, columns=[x.split()[0] for x in SCHEMA.split(", ")])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return media.mapInPandas(run, SCHEMA)


def op2_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the media are written, and features come from what is read back
    return media_features(stored(media_columns(table(spark, sf_dir, "documents")), "media"))


QUERIES = {"op2_mpeg_audio": op2_mpeg_audio}
