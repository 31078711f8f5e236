"""MPEG audio columns: read frames, tags and variable-bitrate tables; store bytes as ancillary data of silent frames.

Reading follows the chain of frame headers and resynchronises after damage: a header counts only if the next frame's
header agrees with it (or the data end there). Header checksums are verified for layer I and III. Durations are exact
sample counts; seek offsets are the byte offsets of the frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from canonframe.llm.common import body, table

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index 1 to 14, Hz by index 0 to 2.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

BLOCK = 64


def _crc_table() -> list[int]:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        out.append(c & 0xFFFF)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    length: int
    samples: int
    mono: bool
    side: int

    @property
    def kind(self) -> tuple:
        return self.version, self.layer, self.rate


_headers: dict[bytes, Header | None] = {}


def header(raw: bytes) -> Header | None:
    """Four bytes as a frame header; None if they are none (free format is not read)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    if raw in _headers:
        return _headers[raw]
    version, layer = {0: 2.5, 2: 2, 3: 1}.get((raw[1] >> 3) & 3), {1: 3, 2: 2, 3: 1}.get((raw[1] >> 1) & 3)
    rate_at, bitrate_at = (raw[2] >> 2) & 3, raw[2] >> 4
    out = None
    if version and layer and rate_at < 3 and 0 < bitrate_at < 15:
        kbit = BITRATES[1 if version == 1 else 2, layer][bitrate_at - 1]
        rate, pad = RATES[version][rate_at], (raw[2] >> 1) & 1
        mono = raw[3] >> 6 == 3
        samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
        length = (12000 * kbit // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbit // rate + pad
        side = ((17, 32) if version == 1 else (9, 17))[not mono] if layer == 3 else 0
        out = Header(version, layer, not raw[1] & 1, kbit, rate, length, samples, mono, side)
    if len(_headers) > 4096:
        _headers.clear()
    _headers[raw] = out
    return out


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    heads: list[Header] = field(default_factory=list)
    bad_checksums: int = 0
    unchecked: int = 0
    junk_bytes: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.heads)

    @property
    def duration(self) -> float:
        return sum(h.samples / h.rate for h in self.heads) if len({h.rate for h in self.heads}) > 1 else self.samples / self.heads[0].rate if self.heads else 0.0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _id3v2(data: bytes) -> tuple[dict[str, str], int]:
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 0x80 for x in data[6:10]):
        return {}, 0
    end, at, tags = min(len(data), 10 + _synchsafe(data[6:10])), 10, {}
    major = data[3]
    while major in (3, 4) and at + 10 <= end and data[at]:
        size = _synchsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        name, raw = data[at : at + 4].decode("latin-1"), data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and raw:
            text = raw[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[raw[0]] if raw[0] < 4 else "latin-1", "replace")
            if name == "TXXX":
                key, _, text = text.partition("\0")
                name = f"TXXX:{key}"
            tags[name] = text.rstrip("\0")
        at += 10 + size
    return tags, end + (10 if major == 4 and data[5] & 0x10 else 0)


def _vbr_table(frame: bytes, h: Header) -> dict:
    at = 4 + 2 * h.protected + h.side
    if frame[at : at + 4] in (b"Xing", b"Info"):
        flags, pos, out = int.from_bytes(frame[at + 4 : at + 8], "big"), at + 8, {"kind": frame[at : at + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(frame[pos : pos + 4], "big")
                pos += 4
        if flags & 4:
            out["toc"] = list(frame[pos : pos + 100])
        return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames, entries, scale, width, per = struct.unpack(">IIHHHH", frame[46:62])
        raw = frame[62 : 62 + entries * width]
        toc = [int.from_bytes(raw[i : i + width], "big") * scale for i in range(0, len(raw) - width + 1, width)] if width else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_per_entry": per}
    return {}


_sums: dict[bytes, int] = {}


def _checksum(covered: bytes) -> int:
    if (c := _sums.get(covered)) is None:
        if len(_sums) > 4096:
            _sums.clear()
        c = _sums[covered] = crc16(covered)
    return c


def parse(data: bytes) -> Audio:
    """Tags, variable-bitrate table, frames, checksums and skipped bytes of an MPEG audio stream; never raises on damage."""
    out = Audio()
    out.tags, at = _id3v2(data)
    end = len(data)
    tail = end - 128 if data[-128:-125] == b"TAG" else -1  # an ID3v1 tag, unless a frame holds these bytes
    kind = None
    while at + 4 <= end:
        if at == tail:
            end = tail
            for name, lo, hi in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
                if text := data[end + lo : end + hi].split(b"\0")[0].decode("latin-1").strip():
                    out.tags.setdefault(f"v1:{name}", text)
            break
        h = header(data[at : at + 4])
        follows = at + h.length if h else 0
        sure = h is not None and follows <= end and (follows + 4 > end or follows == tail or (n := header(data[follows : follows + 4])) is not None and n.kind == h.kind)
        if h is not None and not sure and kind == h.kind and follows <= end and not at < tail < follows:
            sure = True  # the chain led here; damage begins after this frame
        if not sure:
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            nxt = tail if at < tail < nxt else nxt
            out.junk_bytes += nxt - at
            at, kind = nxt, None
            continue
        first = kind is None and not out.heads
        kind = h.kind
        if first and (t := _vbr_table(data[at:follows], h)):
            out.table = t
            out.table["offset"] = at
        else:
            out.offsets.append(at)
            out.heads.append(h)
            if h.protected:
                size = h.side if h.layer == 3 else (16 if h.mono else 32) if h.layer == 1 else 0
                if not size:
                    out.unchecked += 1
                elif _checksum(data[at + 2 : at + 4] + data[at + 6 : at + 6 + size]) != int.from_bytes(data[at + 4 : at + 6], "big"):
                    out.bad_checksums += 1
        at = follows
    out.junk_bytes += max(0, end - at)
    return out


# --- storing bytes -------------------------------------------------------------------------------------------------
_SIDE = 32
_OVERHEAD = 4 + 2 + _SIDE


def _frames() -> list[tuple[int, bytes]]:
    """(payload capacity, the bytes before it) for each bitrate of MPEG-1 layer III, 48 kHz, stereo, with checksum."""
    out = []
    for i in range(1, 15):
        h = bytes([0xFF, 0xFA, i << 4 | 1 << 2, 0])
        side = bytes(_SIDE)  # main_data_begin 0 and part2_3_length 0: silence; what follows is ancillary data
        head = h + crc16(h[2:] + side).to_bytes(2, "big") + side
        out.append((header(h).length - _OVERHEAD, head))
    return out


_KINDS = _frames()


def store(payload: bytes) -> bytes:
    """The payload as ancillary data of silent frames behind an ID3v2.4 tag and a Xing frame: a playable stream."""
    room, head = _KINDS[-1]
    parts, sizes = [], []
    for at in range(0, len(payload), room):
        chunk = payload[at : at + room]
        if len(chunk) == room:
            parts.append(head + chunk)
        else:
            small, small_head = next(k for k in _KINDS if k[0] >= len(chunk))
            parts.append(small_head + chunk + bytes(small - len(chunk)))
        sizes.append(len(parts[-1]))
    total, toc, at, n = sum(sizes), bytearray(100), 0, len(sizes)
    starts = [0]
    for s in sizes:
        starts.append(starts[-1] + s)
    for i in range(100):
        toc[i] = min(255, starts[i * n // 100] * 256 // total) if total else 0
    xing = bytearray(_KINDS[5][1] + bytes(_KINDS[5][0]))
    xing[_OVERHEAD : _OVERHEAD + 16] = b"Xing" + struct.pack(">III", 7, n, total + len(xing))
    xing[_OVERHEAD + 16 : _OVERHEAD + 116] = toc
    text = b"\x03payload_bytes\x00" + str(len(payload)).encode()
    synch = lambda v: bytes([(v >> 21) & 127, (v >> 14) & 127, (v >> 7) & 127, v & 127])
    tag = b"TXXX" + synch(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + synch(len(tag)) + tag + bytes(xing) + b"".join(parts)


def load(media: bytes, audio: Audio | None = None) -> bytes:
    """The payload that store() put in."""
    audio = audio or parse(media)
    if audio.bad_checksums or audio.junk_bytes or "TXXX:payload_bytes" not in audio.tags:
        raise ValueError("not an undamaged stream of store()")
    return b"".join([media[o + _OVERHEAD : o + h.length] for o, h in zip(audio.offsets, audio.heads)])[: int(audio.tags["TXXX:payload_bytes"])]


def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (0 if text else BLOCK))


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration double, seek_offsets array<long>"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("duration", pa.float64()), ("seek_offsets", pa.list_(pa.int64()))]
)


def describe(text: bytes) -> tuple:
    payload = padded(text)
    media = store(payload)
    audio = parse(media)
    back = load(media, audio)
    frames = len(audio.offsets)
    kbit = 8 * sum(h.length for h in audio.heads) / audio.duration / 1000
    feature = f"mpeg1-layer3;rate={audio.heads[0].rate};frames={frames};samples={audio.samples};kbit={kbit:.3f};table={audio.table.get('kind')}:{audio.table.get('frames')};bad={audio.bad_checksums};seek={zlib.crc32(struct.pack(f'<{frames}q', *audio.offsets)):08x}"
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-BLOCK:]), len(media), hashlib.sha256(media).hexdigest(), feature, audio.duration, audio.offsets


def media_features(docs: DataFrame) -> DataFrame:
    """Each text (null: empty) stored as MPEG audio, read back and described; a row for each row, repeated rows alike.

    Empty tables give no rows; other columns are not read. A worker holds one record batch and one document's forms.
    """

    def run(batches):
        for batch in batches:
            rows = [(i, *describe(t.as_buffer().to_pybytes())) for i, t in zip(batch.column(0).to_pylist(), batch.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(_ARROW), _ARROW)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), body("text").cast("binary").alias("text")).mapInArrow(run, SCHEMA)


def op5_media(spark, sf_dir: str) -> DataFrame:
    return media_features(table(spark, sf_dir, "documents"))
