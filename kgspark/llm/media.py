"""Media columns: ISO base media files, walked box by box.

write() stores a payload losslessly as 8-bit PCM samples in a small file; probe() reads any such file:
it walks the nested boxes, decodes the sample tables (also those of movie fragments) and gives codec,
duration and keyframe byte ranges without decoding a payload; samples() reads sample bytes by the tables
alone. Edit lists, which change what is played and not what is stored, are passed over.

Null text is empty text. An empty text gives a payload of 64 zero bytes, a very long one a file with 64-bit
offsets. Repeated rows give equal values. A table without rows gives no rows. Other columns are ignored. A
damaged or foreign file gives what can be read, down to no tracks, and no error: counts are held against
the bytes of their box or of the file, and boxes are walked with a stack, so neither takes memory beyond
the file's own. A sample table without places of chunks has no ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_rows, renamed

#: Boxes that hold boxes, fixed values of the file format.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
UNIT, RATE, KEY_EVERY, CHUNK_SAMPLES = 64, 8000, 16, 32
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I", len(body) + 8) + kind + body
    return struct.pack(">I", 1) + kind + struct.pack(">Q", len(body) + 16) + body


def full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *parts)


def write(payload: bytes) -> bytes:
    """A file with one sound track: samples of 64 bytes, chunks of 32 samples, every 16th a sync sample."""
    n = len(payload) // UNIT
    assert n * UNIT == len(payload) and n
    chunks = -(-n // CHUNK_SAMPLES)
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    lead = 16 if len(payload) + 8 >= 1 << 32 else 8
    at = len(head) + lead + np.arange(chunks, dtype=np.int64) * (UNIT * CHUNK_SAMPLES)
    last = n - (chunks - 1) * CHUNK_SAMPLES
    runs = [(1, CHUNK_SAMPLES, 1)] * (chunks > 1) + [(chunks, last, 1)] * (chunks == 1 or last != CHUNK_SAMPLES)
    sync = np.arange(1, n + 1, KEY_EVERY)
    offsets = full(b"stco", struct.pack(">I", chunks), at.astype(">u4").tobytes()) if at[-1] < 1 << 32 else full(b"co64", struct.pack(">I", chunks), at.astype(">u8").tobytes())
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, RATE << 16))
    table = box(
        b"stbl", full(b"stsd", struct.pack(">I", 1), entry), full(b"stts", struct.pack(">III", 1, n, UNIT)), full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full(b"stsz", struct.pack(">II", UNIT, n)), offsets, full(b"stss", struct.pack(">I", len(sync)), sync.astype(">u4").tobytes()),
    )
    length = n * UNIT
    version, times = (1 << 24, ">QQIQ") if length >= 1 << 32 else (0, ">IIII")
    mdhd = box(b"mdhd", struct.pack(">I", version), struct.pack(times, 0, 0, RATE, length), struct.pack(">HH", 0x55C4, 0))
    mvhd = box(b"mvhd", struct.pack(">I", version), struct.pack(times, 0, 0, RATE, length), struct.pack(">IH10x", 0x10000, 0x100), MATRIX, bytes(24), struct.pack(">I", 2))
    tkhd = box(b"tkhd", struct.pack(">I", version | 3), struct.pack(">QQIIQ" if version else ">IIIII", 0, 0, 1, 0, length), bytes(8), struct.pack(">hhH2x", 0, 0, 0x100), MATRIX, bytes(8))
    hdlr = full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0")
    dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
    minf = box(b"minf", full(b"smhd", bytes(4)), dinf, table)
    moov = box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))
    return head + box(b"mdat", payload) + moov


@dataclass
class Track:
    number: int = 0
    kind: str | None = None
    codec: str | None = None
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    deltas: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))
    sync: np.ndarray | None = None

    def keyframes(self) -> list[tuple[int, int]]:
        """Byte ranges (first, behind the last) of the sync samples; without a table every sample is one."""
        n = len(self.starts)
        at = np.arange(n) if self.sync is None else self.sync[(self.sync >= 1) & (self.sync <= n)] - 1
        return [*zip(self.starts[at].tolist(), (self.starts[at] + self.sizes[at]).tolist(), strict=True)]

    def seconds(self) -> float | None:
        """By the header, or where that has none by the time table."""
        length = self.duration or int((self.deltas[:, 0] * self.deltas[:, 1]).sum())
        return length / self.timescale if self.timescale else None


def walk(data: bytes):
    """(path, first byte, byte behind the last) of the body of every box, parents first. Of a path the last 8 kinds are kept."""
    todo: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while todo:
        at, end, path = todo.pop()
        if at + 8 > end:
            continue
        size, kind, lead = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
        if size == 1 and at + 16 <= end:
            size, lead = int.from_bytes(data[at + 8 : at + 16], "big"), 16
        elif size == 0:
            size = end - at
        if size < lead or at + size > end:
            continue
        own = (*path[-7:], kind)
        yield own, at + lead, at + size
        todo.append((at + size, end, path))
        if kind in CONTAINERS:
            todo.append((at + lead, at + size, own))


def numbers(body: bytes, kind: str, n: int, at: int) -> np.ndarray:
    """n numbers of a table, or as many as its box holds."""
    wide = np.dtype(kind).itemsize
    return np.frombuffer(body, kind, max(0, min(n, (len(body) - at) // wide)), at).astype(np.int64)


def sample_sizes(kind: bytes, body: bytes, most: int) -> np.ndarray:
    """Sizes of the samples by stsz or stz2; equal ones are as many as fit into a file of so many bytes."""
    first, n = struct.unpack_from(">II", body, 4)
    if kind == b"stsz":
        return np.full(min(n, most // first), first, np.int64) if first else numbers(body, ">u4", n, 12)
    if first & 0xFF == 4:
        both = np.frombuffer(body, np.uint8, max(0, min(-(-n // 2), len(body) - 12)), 12)
        return np.stack([both >> 4, both & 15], 1).ravel()[:n].astype(np.int64)
    return numbers(body, ">u1" if first & 0xFF == 8 else ">u2", n, 12)


def placed(track: Track, runs: np.ndarray, chunks: np.ndarray, most: int) -> None:
    """Where the samples of a track lie, by its runs of chunks (first chunk, samples in each, description) and their places."""
    runs, n = runs[: len(runs) // 3 * 3].reshape(-1, 3), len(track.sizes)
    if not (len(runs) and len(chunks) and n):
        track.sizes = track.sizes[:0]
        return
    per = np.repeat(np.minimum(runs[:, 1], n), np.diff(np.append(runs[:, 0].clip(1, len(chunks) + 1), len(chunks) + 1)).clip(0))[: len(chunks)]
    used = int(np.searchsorted(np.cumsum(per), n)) + 1
    per = per[:used]
    of = np.repeat(np.arange(len(per)), per)[:n]
    sizes = track.sizes[: len(of)]
    before = np.cumsum(sizes) - sizes
    first = np.append(0, np.cumsum(per))[:-1]
    track.sizes = sizes
    track.starts = chunks[of].clip(0, most) + before - before[first[of].clip(0, max(len(sizes) - 1, 0))] if len(of) else np.zeros(0, np.int64)


def fragment_run(body: bytes, base: int, size: int, flags: int, most: int) -> tuple[int, np.ndarray, np.ndarray, int]:
    """First byte, sizes, whether each is a sync sample, and the duration of a run of samples, given the defaults of its fragment."""
    given, n = struct.unpack_from(">II", body, 0)
    at, start, first_flags = 8, base, None
    if given & 0x1:
        start, at = base + struct.unpack_from(">i", body, at)[0], at + 4
    if given & 0x4:
        first_flags, at = struct.unpack_from(">I", body, at)[0], at + 4
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if given & bit]
    if not fields:
        n = min(n, most // size) if size else 0
    else:
        n = min(n, (len(body) - at) // (4 * len(fields)))
    table = numbers(body, ">u4", n * len(fields), at).reshape(n, len(fields))
    column = lambda bit, default: table[:, fields.index(bit)] if bit in fields else np.full(n, default, np.int64)
    marks = column(0x400, flags)
    if first_flags is not None and n:
        marks = marks.copy()
        marks[0] = first_flags
    return start, column(0x200, size), marks & 0x10000 == 0, int(column(0x100, 0).sum())


def probe(data: bytes) -> list[Track]:
    tracks: list[Track] = []
    tables: dict[bytes, np.ndarray] = {}
    defaults: dict[int, tuple[int, int]] = {}  # of fragments, by track: size and flags
    found: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = {}
    moof = base = after = 0
    now: tuple[int, int, int] | None = None  # track, size and flags of the fragment

    def close() -> None:
        if tracks:
            placed(tracks[-1], tables.get(b"stsc", np.zeros(0, np.int64)), tables.get(b"chunks", np.zeros(0, np.int64)), len(data))
        tables.clear()

    inside = 0  # where the track ends whose boxes are walked
    for path, a, b in walk(data):
        kind, body = path[-1], data[a:b] if path[-1] not in CONTAINERS | {b"mdat"} else b""
        try:
            if kind == b"trak":
                close()
                tracks.append(Track())
                inside = b
            elif kind == b"trex":
                number, _, _, size, flags = struct.unpack_from(">5I", body, 4)
                defaults[number] = size, flags
            elif kind == b"moof":
                moof = after = a - 8
            elif kind == b"tfhd":
                given, number = struct.unpack_from(">II", body, 0)
                size, flags = defaults.get(number, (0, 0))
                base, at = (moof if given & 0x20000 else after), 8
                if given & 0x1:
                    base, at = struct.unpack_from(">Q", body, at)[0], at + 8
                at += 4 * bool(given & 0x2) + 4 * bool(given & 0x8)
                if given & 0x10:
                    size, at = struct.unpack_from(">I", body, at)[0], at + 4
                if given & 0x20:
                    flags = struct.unpack_from(">I", body, at)[0]
                now, after = (number, size, flags), base
            elif kind == b"trun" and now:
                start, sizes, sync, length = fragment_run(body, base if struct.unpack_from(">I", body)[0] & 0x1 else after, now[1], now[2], len(data))
                start = min(max(start, 0), len(data))
                found.setdefault(now[0], []).append((start + np.cumsum(sizes) - sizes, sizes, sync, length))
                after = start + int(sizes.sum())
            elif not tracks or a >= inside:
                continue
            elif kind == b"tkhd":
                tracks[-1].number = struct.unpack_from(">I", body, 20 if body[0] else 12)[0]
            elif kind == b"mdhd":
                tracks[-1].timescale, tracks[-1].duration = struct.unpack_from(">IQ", body, 20) if body[0] else struct.unpack_from(">II", body, 12)
            elif kind == b"hdlr":
                tracks[-1].kind = body[8:12].decode("latin-1")
            elif kind == b"stsd":
                tracks[-1].codec = body[12:16].decode("latin-1").strip() or None
            elif kind == b"stts":
                tracks[-1].deltas = (x := numbers(body, ">u4", 2 * int.from_bytes(body[4:8], "big"), 8))[: len(x) // 2 * 2].reshape(-1, 2)
            elif kind in (b"stsz", b"stz2"):
                tracks[-1].sizes = sample_sizes(kind, body, len(data))
            elif kind == b"stco":
                tables[b"chunks"] = numbers(body, ">u4", int.from_bytes(body[4:8], "big"), 8)
            elif kind == b"co64":
                tables[b"chunks"] = numbers(body, ">i8", int.from_bytes(body[4:8], "big"), 8)
            elif kind == b"stsc":
                tables[kind] = numbers(body, ">u4", 3 * int.from_bytes(body[4:8], "big"), 8)
            elif kind == b"stss":
                tracks[-1].sync = numbers(body, ">u4", int.from_bytes(body[4:8], "big"), 8)
        except (struct.error, ValueError, IndexError):
            continue
    close()
    for t in tracks:
        for starts, sizes, sync, length in found.get(t.number, ()):
            own = len(t.starts)
            if t.sync is None:
                t.sync = np.arange(1, own + 1)
            t.starts, t.sizes, t.duration = np.append(t.starts, starts), np.append(t.sizes, sizes), t.duration + length
            t.sync = np.append(t.sync, np.flatnonzero(sync) + own + 1)
    return tracks


def samples(data: bytes, track: Track) -> bytes:
    """The bytes of all samples in order; samples that touch are read as one run."""
    if not len(track.starts):
        return b""
    breaks = np.flatnonzero(track.starts[1:] != track.starts[:-1] + track.sizes[:-1]) + 1
    firsts, lasts = np.append(0, breaks), np.append(breaks, len(track.starts)) - 1
    return b"".join(data[a:b] for a, b in zip(track.starts[firsts].tolist(), (track.starts[lasts] + track.sizes[lasts]).tolist(), strict=True))


def feature(tracks: list[Track]) -> str:
    """codec;seconds;samples;keyframes;CRC-32 of all keyframe byte ranges of the first track, written first-behind and joined by commas."""
    if not tracks or tracks[0].codec is None:
        return ""
    t = tracks[0]
    keys = t.keyframes()
    return f"{t.codec};{t.seconds() or 0:.6f};{len(t.starts)};{len(keys)};{zlib.crc32(','.join(f'{a}-{b}' for a, b in keys).encode()):08x}"


def spans(ranges: list[tuple[int, int]]) -> list[dict[str, int]]:
    return [{"first": a, "behind": b} for a, b in ranges]


SPANS, SPANS_DDL = pa.list_(pa.struct([("first", pa.int64()), ("behind", pa.int64())])), "array<struct<first:long,behind:long>>"


def probe_media(files: DataFrame, key: str = "media_id", data: str = "data") -> DataFrame:
    """A row for each track: media_id, track, kind, codec, seconds, samples, keyframes (array of byte ranges)."""

    def make():
        def row(k, d):
            return [(k, i, t.kind, t.codec, t.seconds(), len(t.starts), spans(t.keyframes())) for i, t in enumerate(probe(d or b""))]

        return row

    return map_rows(
        renamed(files, {"media_id": key, "data": data}), ["media_id", "data"], make, "media_id long, track int, kind string, codec string, seconds double, samples long, keyframes " + SPANS_DDL,
        pa.schema([("media_id", pa.int64()), ("track", pa.int32()), ("kind", pa.string()), ("codec", pa.string()), ("seconds", pa.float64()), ("samples", pa.int64()), ("keyframes", SPANS)]), repeat=True,
    )


def payload_of(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """media_id, n_bytes, data: each text as a file."""

    def make():
        def row(d, t):
            payload, n = payload_of(t)
            return d, n, write(payload)

        return row

    return map_rows(renamed(docs, {"doc_id": doc_id, "text": text}), ["doc_id", "text"], make, "media_id long, n_bytes long, data binary", pa.schema([("media_id", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary())]))


def media_columns(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write each text as a file, read it back by its sample tables, and digest what was read."""

    def make():
        def row(d, t):
            payload, n = payload_of(t)
            data = write(payload)
            tracks = probe(data)
            back = samples(data, tracks[0])
            return d, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(tracks), spans(tracks[0].keyframes())

        return row

    return map_rows(
        renamed(docs, {"doc_id": doc_id, "text": text}), ["doc_id", "text"], make,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, keyframes " + SPANS_DDL,
        pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("keyframes", SPANS)]),
    )
