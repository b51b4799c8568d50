"""Matroska media columns: EBML elements, clusters, lacing and cues parsed into packet tables.

``read`` walks a file's elements once and yields a packet for each frame: track, timestamp, byte range. Byte ranges
refer to the stored bytes, so a packet's data is a slice and is not copied. ``write`` makes audio files of 8-bit
samples, with blocks in any lacing and a cue for each cluster.

Each row's file is parsed on its own, in one narrow pass over Arrow batches; a table of packets has a row per frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element ids of the format (fixed values, with their length marks).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
#: Elements that end a cluster of unknown size.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Samples a second, samples of a frame, frames of a block and blocks of a cluster that ``store_bytes`` uses.
RATE, FRAME, LACED, BLOCKS = 8000, 192, 8, 20


class Malformed(ValueError):
    """The bytes are not Matroska from here on."""


# -- reading -----------------------------------------------------------------


def vint(data, at: int, end: int) -> tuple[int, int, int]:
    """A variable-length integer at ``at``: its value with the length mark, its value without it, its length."""
    if at >= end or not data[at]:
        raise Malformed(f"no variable-length integer at {at}")
    n = 9 - data[at].bit_length()
    if at + n > end:
        raise Malformed(f"cut off at {at}")
    marked = int.from_bytes(data[at : at + n], "big")
    return marked, marked & ~(1 << 7 * n), n


def element(data, at: int, end: int) -> tuple[int, int, int]:
    """The element at ``at``: id, start of its content, end of its content (-1 if its size is unknown)."""
    name, _, n = vint(data, at, end)
    if n > 4:
        raise Malformed(f"element id of {n} bytes at {at}")
    _, size, m = vint(data, at + n, end)
    start = at + n + m
    if size == (1 << 7 * m) - 1:
        return name, start, -1
    if start + size > end:
        raise Malformed(f"element at {at} ends beyond its parent")
    return name, start, start + size


def children(data, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        name, start, stop = element(data, at, end)
        yield name, start, end if stop < 0 else stop
        at = end if stop < 0 else stop


def uint(data, start: int, stop: int) -> int:
    return int.from_bytes(data[start:stop], "big")


def real(data, start: int, stop: int) -> float:
    return {0: lambda _: 0.0, 4: lambda b: struct.unpack(">f", b)[0], 8: lambda b: struct.unpack(">d", b)[0]}[stop - start](bytes(data[start:stop]))


@dataclass
class Packet:
    track: int
    timestamp_ns: int
    offset: int
    length: int
    keyframe: bool
    lacing: str
    cluster: int  # where its cluster starts


@dataclass
class Cue:
    timestamp_ns: int
    track: int
    cluster: int  # where the cluster starts in the file
    relative: int  # the block's place in the cluster's content, -1 if not given


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[Packet] = field(default_factory=list)
    cues: list[Cue] = field(default_factory=list)
    scale: int = 1_000_000
    error: str | None = None


def _lace_sizes(data, at: int, end: int, lacing: int) -> tuple[list[int], int]:
    """Sizes of a laced block's frames, and where the first starts."""
    if at >= end:
        raise Malformed("a laced block has no frame count")
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed("lace sizes are cut off")
                size += data[at]
                at += 1
                if data[at - 1] < 255:
                    break
            sizes.append(size)
    elif lacing == EBML_LACING and n > 1:
        _, size, m = vint(data, at, end)
        at += m
        sizes.append(size)
        for _ in range(n - 2):
            _, raw, m = vint(data, at, end)
            at += m
            size += raw - ((1 << 7 * m - 1) - 1)  # differences are stored with half their range added
            sizes.append(size)
    elif lacing == FIXED:
        if (end - at) % n:
            raise Malformed("a fixed lace does not divide its block")
        return [(end - at) // n] * n, at
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise Malformed("lace sizes exceed their block")
    return [*sizes, last], at


def _block(data, start: int, stop: int, media: Media, base: int, cluster: int, keyframe: bool | None) -> None:
    _, track, n = vint(data, start, stop)
    if start + n + 3 > stop:
        raise Malformed(f"block at {start} is cut off")
    relative = int.from_bytes(data[start + n : start + n + 2], "big", signed=True)
    flags = data[start + n + 2]
    lacing, at = flags >> 1 & 3, start + n + 3
    sizes, at = ([stop - at], at) if lacing == NO_LACING else _lace_sizes(data, at, stop, lacing)
    time, step = (base + relative) * media.scale, media.tracks.get(track, {}).get("frame_ns", 0)
    key = bool(flags & 0x80) if keyframe is None else keyframe
    for i, size in enumerate(sizes):
        media.packets.append(Packet(track, time + i * step, at, size, key, LACINGS[lacing], cluster))
        at += size


def _cluster(data, start: int, stop: int, media: Media, at: int) -> None:
    base = 0
    for name, a, b in children(data, start, stop):
        if name == TIMESTAMP:
            base = uint(data, a, b)
        elif name == SIMPLE_BLOCK:
            _block(data, a, b, media, base, at, None)
        elif name == BLOCK_GROUP:
            inner = list(children(data, a, b))
            key = all(x[0] != REFERENCE_BLOCK for x in inner)
            for inner_name, c, d in inner:
                if inner_name == BLOCK:
                    _block(data, c, d, media, base, at, key)


def _track(data, start: int, stop: int) -> tuple[int, dict]:
    out: dict = {"codec": "", "type": 0, "frame_ns": 0, "rate": 0.0, "channels": 1, "bits": 0}
    number = 0
    for name, a, b in children(data, start, stop):
        if name == TRACK_NUMBER:
            number = uint(data, a, b)
        elif name == CODEC_ID:
            out["codec"] = bytes(data[a:b]).decode("ascii", "replace")
        elif name == TRACK_TYPE:
            out["type"] = uint(data, a, b)
        elif name == DEFAULT_DURATION:
            out["frame_ns"] = uint(data, a, b)
        elif name == AUDIO:
            for inner, c, d in children(data, a, b):
                if inner == SAMPLING_FREQUENCY:
                    out["rate"] = real(data, c, d)
                elif inner == CHANNELS:
                    out["channels"] = uint(data, c, d)
                elif inner == BIT_DEPTH:
                    out["bits"] = uint(data, c, d)
    return number, out


def _cue_points(data, start: int, stop: int, media: Media, segment: int) -> None:
    for name, a, b in children(data, start, stop):
        if name != CUE_POINT:
            continue
        time, places = 0, []
        for inner, c, d in children(data, a, b):
            if inner == CUE_TIME:
                time = uint(data, c, d)
            elif inner == CUE_TRACK_POSITIONS:
                places.append({x: uint(data, e, f) for x, e, f in children(data, c, d)})
        media.cues += [Cue(time * media.scale, p.get(CUE_TRACK, 0), segment + p.get(CUE_CLUSTER_POSITION, 0), p.get(CUE_RELATIVE_POSITION, -1)) for p in places]


def _unknown_end(data, at: int, end: int) -> int:
    """Where a cluster of unknown size ends: before the next top-level element."""
    while at < end:
        name, _, stop = element(data, at, end)
        if name in TOP_LEVEL or stop < 0:
            return at
        at = stop
    return end


def read(data: bytes) -> Media:
    """Parse a file. What precedes a fault is kept, and ``error`` says what the fault was."""
    media, at, end = Media(), 0, len(data)
    try:
        if not data or element(data, 0, end)[0] != EBML:
            raise Malformed("no EBML header")
        while at < end:
            name, start, stop = element(data, at, end)
            if name != SEGMENT:
                at = end if stop < 0 else stop
                continue
            inside, stop = start, end if stop < 0 else stop
            while inside < stop:
                name, a, b = element(data, inside, stop)
                if b < 0:
                    b = _unknown_end(data, a, stop) if name == CLUSTER else stop
                if name == INFO:
                    for inner, c, d in children(data, a, b):
                        if inner == TIMESTAMP_SCALE:
                            media.scale = uint(data, c, d)
                elif name == TRACKS:
                    media.tracks |= dict(_track(data, c, d) for inner, c, d in children(data, a, b) if inner == TRACK_ENTRY)
                elif name == CLUSTER:
                    _cluster(data, a, b, media, inside)
                elif name == CUES:
                    _cue_points(data, a, b, media, start)
                inside = b
            at = stop
    except (Malformed, KeyError, IndexError) as e:
        media.error = str(e)
    return media


# -- writing -----------------------------------------------------------------


def _size(n: int, width: int = 0) -> bytes:
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _uint(name: int, n: int) -> bytes:
    return _element(name, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _laced(frames: list[bytes], lacing: int) -> bytes:
    if lacing == NO_LACING:
        if len(frames) != 1:
            raise ValueError("several frames need a lacing")
        return frames[0]
    out = bytearray([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == FIXED and len(set(sizes)) > 1:
        raise ValueError("a fixed lacing needs frames of one size")
    if lacing == XIPH:
        for n in sizes[:-1]:
            out += b"\xff" * (n // 255) + bytes([n % 255])
    elif lacing == EBML_LACING and len(sizes) > 1:
        out += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:-1]):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            out += _size(b - a + (1 << 7 * width - 1) - 1, width)
    return bytes(out) + b"".join(frames)


def write(blocks: list[list[bytes]], lacing: int, frame_ms: int, rate: int = RATE, per_cluster: int = BLOCKS) -> bytes:
    """An audio file with one track of 8-bit samples: each block laces its frames, clusters take ``per_cluster`` blocks."""
    header = _element(EBML, b"".join([_uint(EBML_VERSION, 1), _uint(EBML_READ_VERSION, 1), _uint(EBML_MAX_ID, 4), _uint(EBML_MAX_SIZE, 8), _element(DOC_TYPE, b"matroska"), _uint(DOC_TYPE_VERSION, 4), _uint(DOC_TYPE_READ_VERSION, 2)]))
    total_ms = sum(map(len, blocks)) * frame_ms
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", total_ms)) + _element(MUXING_APP, b"loomnote") + _element(WRITING_APP, b"loomnote"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    track = _element(TRACK_ENTRY, b"".join([_uint(TRACK_NUMBER, 1), _uint(TRACK_UID, 1), _uint(TRACK_TYPE, 2), _uint(FLAG_LACING, int(lacing > 0)), _uint(DEFAULT_DURATION, frame_ms * 1_000_000), _element(CODEC_ID, b"A_PCM/INT/LIT"), audio]))
    body = bytearray(info + _element(TRACKS, track))
    cues, time = [], 0
    for i in range(0, len(blocks), per_cluster):
        start, stamp = time, _uint(TIMESTAMP, time)
        inner = [stamp]
        for frames in blocks[i : i + per_cluster]:
            inner.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", time - start, 0x80 | lacing << 1) + _laced(frames, lacing)))
            time += len(frames) * frame_ms
        place = _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, len(body)) + _uint(CUE_RELATIVE_POSITION, len(stamp)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, start) + place))
        body += _element(CLUSTER, b"".join(inner))
    body += _element(CUES, b"".join(cues))
    return header + SEGMENT.to_bytes(4, "big") + _size(len(body), 8) + bytes(body)


def store_bytes(payload: bytes) -> bytes:
    """``payload``, a multiple of ``FRAME`` bytes, as 8-bit samples in fixed-laced blocks."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    return write([frames[i : i + LACED] for i in range(0, len(frames), LACED)], FIXED, FRAME * 1000 // RATE)


def stored_bytes(data: bytes, track: int = 1) -> bytes:
    """The data of a track's packets, by their byte ranges."""
    return b"".join(data[p.offset : p.offset + p.length] for p in read(data).packets if p.track == track)


def features(samples: bytes, packets: int) -> str:
    """What describes a stored signal: packets, samples, mean, deviation, crossings of the middle, loudest and quietest packet."""
    import numpy as np

    x = np.frombuffer(samples, "u1").astype(np.int32) - 128
    if not len(x):
        return "packets=0"
    whole = x[: len(x) // FRAME * FRAME].reshape(-1, FRAME) if len(x) >= FRAME else x[None, :]
    loud = np.sqrt((whole.astype(float) ** 2).mean(1))
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"packets={packets};samples={len(x)};mean={x.mean():.4f};deviation={x.std():.4f};crossings={crossings};loudest={loud.max():.4f};quietest={loud.min():.4f}"


# -- columns -----------------------------------------------------------------


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per packet of each row's file: ``id_col, packet, track, timestamp_ns, offset, length, keyframe, lacing, cluster, cued``.

    ``cued`` says that a cue points to the packet's cluster. A null, empty or malformed file has the packets before its
    fault, perhaps none; ``faults`` lists them. Other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()
    names = ["packet", "track", "timestamp_ns", "offset", "length", "keyframe", "lacing", "cluster", "cued"]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.int64(), pa.bool_()]
        for b in batches:
            for row in range(b.num_rows):  # a batch for each file: a long one does not add to the others
                media = read(b.column(1)[row].as_py() or b"")
                cued = {c.cluster for c in media.cues}
                cols = zip(*((i, p.track, p.timestamp_ns, p.offset, p.length, p.keyframe, p.lacing, p.cluster, p.cluster in cued) for i, p in enumerate(media.packets))) if media.packets else [[]] * len(names)
                ids = b.column(0).take(pa.array([row] * len(media.packets), pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, t) for c, t in zip(cols, types))], names=[id_col, *names])

    schema = f"`{id_col}` {kind}, packet long, track long, timestamp_ns long, offset long, length long, keyframe boolean, lacing string, cluster long, cued boolean"
    return df.select(F.col(id_col), F.col(media_col).cast("binary").alias("media")).mapInArrow(parse, schema)


def cue_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row per cue: ``id_col, timestamp_ns, track, cluster, relative``."""
    kind = df.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(row, c) for row in range(b.num_rows) for c in read(b.column(1)[row].as_py() or b"").cues]
            cols = [[getattr(c, k) for _, c in found] for k in ("timestamp_ns", "track", "cluster", "relative")]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([r for r, _ in found], pa.int64())), *(pa.array(c, pa.int64()) for c in cols)], names=[id_col, "timestamp_ns", "track", "cluster", "relative"])

    return df.select(F.col(id_col), F.col(media_col).cast("binary").alias("media")).mapInArrow(parse, f"`{id_col}` {kind}, timestamp_ns long, track long, cluster long, relative long")


def faults(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``id_col, error`` of the rows whose file cannot be parsed to its end (a null or empty one has no EBML header)."""
    kind = df.schema[id_col].dataType.simpleString()

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = [read(m or b"").error for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(errors, pa.string())], names=[id_col, "error"])

    return df.select(F.col(id_col), F.col(media_col).cast("binary").alias("media")).mapInArrow(parse, f"`{id_col}` {kind}, error string").where("error is not null")


def text_media(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = False) -> DataFrame:
    """Store each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, as Matroska audio; read them back and describe them.

    Gives ``id_col, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, packets`` and,
    with ``keep_media``, ``media``. All but ``n_bytes`` and the media's own figures come from the bytes read back. A null
    text is empty: one packet of spaces. Null ids and repeated rows stay; other columns are left out.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t in b.column(1).to_pylist():
                raw = t.encode("utf-8")
                media = store_bytes(raw + b" " * (-len(raw) % FRAME or (FRAME if not raw else 0)))
                parsed = read(media)
                if parsed.error:
                    raise Malformed(parsed.error)
                back = b"".join(media[p.offset : p.offset + p.length] for p in parsed.packets)
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(media), hashlib.sha256(media).hexdigest(), features(back, len(parsed.packets)), len(parsed.packets), media if keep_media else None))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(types), types)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "packets", "media"])

    schema = f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, packets long, media binary"
    out = df.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(store, schema)
    return out if keep_media else out.drop("media")
