"""Matroska: EBML elements, clusters, lacing and cues, parsed into packet tables.

``parse`` reads a file held as bytes: variable-length ids and sizes (unknown sizes too), tracks, clusters,
SimpleBlocks and BlockGroups with no, Xiph, fixed-size or EBML lacing, and cues. Each frame becomes a packet
with its track, timestamp, byte range and flags. ``mux`` writes samples of 8 bits as one PCM track: frames of
``FRAME`` bytes, laced ``LACE`` to a block, clusters with cues.

The query stores each document's text as such a track, parses the stored bytes and works on what it reads back.

Defined cases: a null or empty text is 64 zero bytes; equal texts give equal files, byte for byte; damaged or
truncated files raise ValueError in ``parse``, and give no packets, with the error in a column, in ``packets``; a null
file has no packets; repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from engramite.llm.common import doc_id, map_batches, texts_of

# Element ids of the format.
EBML, DOCTYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x2AD7B1, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
AUDIO, RATE, CHANNELS, BIT_DEPTH, LACING_FLAG, DEFAULT_DURATION = 0xE1, 0xB5, 0x9F, 0x6264, 0x9C, 0x23E383
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
_TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}

SAMPLE_RATE, FRAME, LACE, CLUSTER_BLOCKS = 8000, 512, 8, 8
SCHEMA = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
PACKETS = "doc_id bigint, track bigint, packet bigint, timestamp bigint, offset bigint, size bigint, keyframe boolean, lacing string, cluster_offset bigint, codec string, error string"
_LACINGS = ("none", "xiph", "fixed", "ebml")


@dataclass
class Packet:
    track: int
    timestamp: int
    offset: int
    size: int
    keyframe: bool
    lacing: str
    cluster: int


@dataclass
class Media:
    scale: int = 1_000_000
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    doctype: str = ""


def read_vint(data: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """Value and length of a variable-length integer; -1 for the unknown size."""
    if at >= len(data) or data[at] == 0:
        raise ValueError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise ValueError(f"truncated integer at byte {at}")
    raw = int.from_bytes(data[at : at + n], "big")
    if keep_marker:
        return raw, n
    value = raw - (1 << (7 * n))
    return (-1 if value == (1 << (7 * n)) - 1 else value), n


def elements(data: bytes, at: int, end: int):
    """Yields (id, start of body, end of body). An element of unknown size reaches to the next that cannot be its child."""
    while at < end:
        eid, n = read_vint(data, at, True)
        size, m = read_vint(data, at + n, False)
        body = at + n + m
        if size < 0:
            stop = end if eid == SEGMENT else _unknown_end(data, body, end)
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"element at byte {at} reaches beyond its parent")
        yield eid, body, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        eid, n = read_vint(data, at, True)
        if eid in _TOP:
            return at
        size, m = read_vint(data, at + n, False)
        if size < 0:
            raise ValueError(f"unknown size inside an element of unknown size at byte {at}")
        at += n + m + size
    return end


def _uint(data: bytes, a: int, b: int) -> int:
    if b - a > 8:
        raise ValueError(f"an integer of {b - a} bytes at byte {a}")
    return int.from_bytes(data[a:b], "big")


def _float(data: bytes, a: int, b: int) -> float:
    if b - a not in (0, 4, 8):
        raise ValueError(f"a float of {b - a} bytes at byte {a}")
    return struct.unpack(">f" if b - a == 4 else ">d", data[a:b])[0] if b > a else 0.0


def _frames(data: bytes, a: int, b: int, lacing: int) -> list[tuple[int, int]]:
    if lacing == 0:
        return [(a, b - a)]
    if a >= b:
        raise ValueError("a laced block without frames")
    count, at = data[a] + 1, a + 1
    if lacing == 2:
        each, rest = divmod(b - at, count)
        if rest:
            raise ValueError("fixed lacing with a rest")
        return [(at + i * each, each) for i in range(count)]
    sizes = []
    if lacing == 1:
        for _ in range(count - 1):
            total = 0
            while True:
                if at >= b:
                    raise ValueError("truncated lace")
                total += data[at]
                at += 1
                if data[at - 1] != 255:
                    break
            sizes.append(total)
    else:
        for i in range(count - 1):
            value, n = read_vint(data, at, False)
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << (7 * n - 1)) - 1))
            at += n
            if sizes[-1] < 0:
                raise ValueError("a lace of negative size")
    sizes.append(b - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace sizes beyond the block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return out


def _block(data: bytes, a: int, b: int, media: Media, cluster: int, time: int, simple: bool, key: bool) -> None:
    track, n = read_vint(data, a, False)
    if a + n + 3 > b:
        raise ValueError("truncated block")
    relative, flags = struct.unpack_from(">hB", data, a + n)
    lacing = flags >> 1 & 3
    step = media.tracks.get(track, {}).get("duration", 0)
    for i, (at, size) in enumerate(_frames(data, a + n + 3, b, lacing)):
        stamp = time + relative + (i * step) // media.scale
        if stamp >= 1 << 63:
            raise ValueError(f"a timestamp beyond 64 bits at byte {a}")
        media.packets.append(Packet(track, stamp, at, size, bool(flags & 0x80) if simple else key, _LACINGS[lacing], cluster))


def parse(data: bytes) -> Media:
    media, seen = Media(), False
    for eid, a, b in elements(data, 0, len(data)):
        if eid == EBML:
            for e, x, y in elements(data, a, b):
                if e == DOCTYPE:
                    media.doctype = data[x:y].rstrip(b"\0").decode("ascii", "replace")
        elif eid == SEGMENT:
            seen = True
            _segment(data, a, b, media)
    if not seen:
        raise ValueError("no segment")
    return media


def _segment(data: bytes, a: int, b: int, media: Media) -> None:
    for eid, x, y in elements(data, a, b):
        if eid == INFO:
            for e, p, q in elements(data, x, y):
                if e == TIMESTAMP_SCALE:
                    media.scale = _uint(data, p, q) or 1
        elif eid == TRACKS:
            for e, p, q in elements(data, x, y):
                if e == TRACK_ENTRY:
                    t = {"codec": "", "type": 0, "duration": 0, "number": 0}
                    for f, u, v in elements(data, p, q):
                        if f == TRACK_NUMBER:
                            t["number"] = _uint(data, u, v)
                        elif f == CODEC_ID:
                            t["codec"] = data[u:v].rstrip(b"\0").decode("ascii", "replace")
                        elif f == TRACK_TYPE:
                            t["type"] = _uint(data, u, v)
                        elif f == DEFAULT_DURATION:
                            t["duration"] = _uint(data, u, v)
                        elif f == AUDIO:
                            for g, s, z in elements(data, u, v):
                                if g == BIT_DEPTH:
                                    t["bits"] = _uint(data, s, z)
                                elif g == CHANNELS:
                                    t["channels"] = _uint(data, s, z)
                                elif g == RATE:
                                    t["rate"] = _float(data, s, z)
                    media.tracks[t["number"]] = t
        elif eid == CLUSTER:
            time, position = 0, x
            for e, p, q in elements(data, x, y):
                if e == CLUSTER_TIME:
                    time = _uint(data, p, q)
                elif e == SIMPLE_BLOCK:
                    _block(data, p, q, media, position, time, True, False)
                elif e == BLOCK_GROUP:
                    inner = list(elements(data, p, q))
                    key = all(f != REFERENCE for f, _, _ in inner)
                    for f, u, v in inner:
                        if f == BLOCK:
                            _block(data, u, v, media, position, time, False, key)
        elif eid == CUES:
            for e, p, q in elements(data, x, y):
                if e == CUE_POINT:
                    time, where = 0, []
                    for f, u, v in elements(data, p, q):
                        if f == CUE_TIME:
                            time = _uint(data, u, v)
                        elif f == CUE_POSITIONS:
                            got = {g: _uint(data, s, z) for g, s, z in elements(data, u, v)}
                            where.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0)))
                    media.cues += [(time, t, a + c) for t, c in where]


def _vint(value: int) -> bytes:
    n = 1
    while value >= (1 << (7 * n)) - 1:
        n += 1
    return (value | 1 << (7 * n)).to_bytes(n, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _number(eid: int, value: int) -> bytes:
    return element(eid, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, _number(0x4286, 1) + _number(0x42F7, 1) + _number(0x42F2, 4) + _number(0x42F3, 8) + element(DOCTYPE, b"matroska") + _number(0x4287, 4) + _number(0x4285, 2))
_SCALE = 1_000_000
_FRAME_NS = FRAME * 1_000_000_000 // SAMPLE_RATE
_SETUP = element(INFO, _number(TIMESTAMP_SCALE, _SCALE) + element(0x4D80, b"engramite") + element(0x5741, b"engramite")) + element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(LACING_FLAG, 1) + _number(DEFAULT_DURATION, _FRAME_NS) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + element(AUDIO, element(RATE, struct.pack(">d", float(SAMPLE_RATE))) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """One PCM track of 8-bit samples. Full laces have fixed sizes; a block with a shorter last frame is laced the EBML way."""
    per_cluster = FRAME * LACE * CLUSTER_BLOCKS
    parts, at, cues = [_SETUP], len(_SETUP), []
    for c in range(0, max(1, len(payload)), per_cluster):
        start_ms = c // FRAME * _FRAME_NS // _SCALE
        blocks = [_number(CLUSTER_TIME, start_ms)]
        for b in range(c, min(c + per_cluster, len(payload)), FRAME * LACE):
            chunk = payload[b : min(b + FRAME * LACE, c + per_cluster)]
            relative = b // FRAME * _FRAME_NS // _SCALE - start_ms
            count = -(-len(chunk) // FRAME)
            if count == 1:
                flags, lace = 0x80, b""
            elif len(chunk) % FRAME == 0:
                flags, lace = 0x80 | 2 << 1, bytes([count - 1])
            else:
                same = b"\xbf"  # a difference of 0
                flags, lace = 0x80 | 3 << 1, bytes([count - 1]) + _vint(FRAME) + same * (count - 2)
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", relative, flags) + lace + chunk))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, _number(CUE_TIME, start_ms) + element(CUE_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def payload_of(text: str) -> tuple[bytes, int]:
    raw = text.encode("utf-8")
    return raw + bytes(-len(raw) % 64 if raw else 64), len(raw)


def samples(data: bytes, media: Media, track: int = 1) -> bytes:
    return b"".join(data[p.offset : p.offset + p.size] for p in media.packets if p.track == track)


def feature(data: bytes, media: Media, payload: bytes) -> str:
    """Packets, clusters that cues lead to, lacings, duration and the shape of the signal, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.float64) - 128.0
    crossings = int(np.count_nonzero(np.diff(x >= 0)))
    laced = "/".join(str(sum(p.lacing == k for p in media.packets)) for k in _LACINGS)
    clusters = {p.cluster for p in media.packets}
    cued = sum(data[c : c + 4] == b"\x1f\x43\xb6\x75" for _, _, c in media.cues)
    return f"packets={len(media.packets)};clusters={len(clusters)};cued={cued};lacing={laced};last_ms={media.packets[-1].timestamp if media.packets else 0};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={crossings}"


def store_as_media(documents: DataFrame) -> DataFrame:
    """Mux each whole text, parse the stored bytes, and describe what was read back."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {n.split(" ")[0]: [] for n in SCHEMA.split(", ")[1:]}
            for text in texts_of(batch):
                payload, n = payload_of(text)
                data = mux(payload)
                media = parse(data)
                back = samples(data, media)
                for name, value in (
                    ("n_bytes", n), ("payload_bytes", len(back)), ("payload_sha256", hashlib.sha256(back).hexdigest()), ("tail_crc32", zlib.crc32(back[-64:])),
                    ("media_bytes", len(data)), ("media_sha256", hashlib.sha256(data).hexdigest()), ("feature", feature(data, media, back)),
                ):
                    out[name].append(value)
            return out | {"doc_id": batch.column("doc_id")}

        return work

    return map_batches(documents.select(doc_id(documents).alias("doc_id"), documents["text"]), make, SCHEMA)


def packets(files: DataFrame, column: str = "media") -> DataFrame:
    """The packet table of files (doc_id, and the bytes in ``column``): one row per frame."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            rows = []
            for key, data in zip(batch.column("doc_id").to_pylist(), batch.column("data").to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    m = parse(data)
                except ValueError as e:
                    rows.append((key, None, None, None, None, None, None, None, None, None, str(e)))
                    continue
                rows += [(key, p.track, i, p.timestamp, p.offset, p.size, p.keyframe, p.lacing, p.cluster, m.tracks.get(p.track, {}).get("codec"), None) for i, p in enumerate(m.packets)]
            kinds = [pa.int64()] * 6 + [pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.string()]
            names = [x.split(" ")[0] for x in PACKETS.split(", ")]
            return {n: pa.array([r[i] for r in rows], k) for i, (n, k) in enumerate(zip(names, kinds, strict=True))}

        return work

    return map_batches(files.select(doc_id(files).alias("doc_id"), files[column].alias("data")), make, PACKETS)


def write_media(documents: DataFrame) -> DataFrame:
    """doc_id and the Matroska file of each whole text."""

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            return {"doc_id": batch.column("doc_id"), "media": pa.array([mux(payload_of(t)[0]) for t in texts_of(batch)], pa.binary())}

        return work

    return map_batches(documents.select(doc_id(documents).alias("doc_id"), F.col("text")), make, "doc_id bigint, media binary")
