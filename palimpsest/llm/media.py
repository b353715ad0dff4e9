"""Media columns: texts stored as ISO base media files, read back by walking their boxes.

``pack`` writes a payload as an uncompressed 8-bit audio track: ftyp, moov with the sample tables, mdat. Each
sample of the track is one frame of 576 one-byte units. ``inspect`` walks the nested boxes of any such file,
decodes the sample tables (stsd, stts, stss, stsc, stsz or stz2, stco or co64) and those of fragments (trex, tfhd, trun), and
returns codec, duration and the byte range of every keyframe; it never looks into mdat. The payload is read back through
the ranges alone. ``describe`` does this for a column of given files, ``store`` for texts that it packs itself.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import small_arrow_batches

FRAME = 576
FILL = b"\xff"
TIMESCALE = 48_000
#: One frame in so many is a keyframe.
KEY_EVERY = 16
#: Fixed values of ISO/IEC 14496-12: boxes that hold boxes.
CONTAINERS = (b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf")
#: Fixed value of ISO/IEC 14496-12: the unity transformation matrix.
MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes, frame: int = FRAME) -> bytes:
    """Bytes 255 up to a positive multiple of ``frame``."""
    size = max(1, -(-len(data) // frame)) * frame
    return data + FILL * (size - len(data))


def pack(payload: bytes, frame: int = FRAME, key_every: int = KEY_EVERY) -> bytes:
    """An ISO media file whose only track holds ``payload`` in samples of ``frame`` units."""
    samples = len(payload) // frame
    if not samples or len(payload) % frame:
        raise ValueError(f"a payload is a positive multiple of {frame} bytes")
    length = samples * frame
    keys = np.arange(1, samples + 1, key_every, dtype=">u4")
    head = box(b"ftyp", b"isom", struct.pack(">I", 0), b"isom", b"mp41")
    entry = box(b"raw ", bytes(6), struct.pack(">HHHIHHHHI", 1, 0, 0, 0, 1, 8, 0, 0, TIMESCALE << 16))

    def moov(offset: int) -> bytes:
        places = full(b"co64", struct.pack(">IQ", 1, offset))
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, samples, frame)),
            full(b"stss", struct.pack(">I", len(keys)), keys.tobytes()),
            full(b"stsc", struct.pack(">IIII", 1, 1, samples, 1)),
            full(b"stsz", struct.pack(">II", frame, samples)),
            places,
        )
        dinf = box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1)))
        minf = box(b"minf", full(b"smhd", bytes(4)), dinf, stbl)
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, length, 0x55C4, 0), version=1)
        mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"soun", bytes(12), b"payload\0"), minf)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, length), bytes(8), struct.pack(">hhhh", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQ", 0, 0, TIMESCALE, length), struct.pack(">IHH", 0x10000, 0x100, 0), bytes(8), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    at = len(head) + len(moov(0)) + (8 if len(payload) + 8 < 1 << 32 else 16)
    return head + moov(at) + box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of box types, start and end of the body) of every box, depth first. A box cut short ends the walk."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1 and start + 16 <= end:
            (size,), head = struct.unpack_from(">Q", data, start + 8), 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield (*path, kind), start + head, start + size
        if kind in CONTAINERS:
            yield from walk(data, start + head, start + size, (*path, kind))
        start += size


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    id: int = 0
    timescale: int = 0
    duration: int = 0
    offsets: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    sizes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def ranges(self) -> list[tuple[int, int]]:
        """First byte and the byte after the last of every keyframe."""
        return [(int(self.offsets[k]), int(self.offsets[k] + self.sizes[k])) for k in self.keys]


class Box:
    """The body of a box; what it is too short for raises EOFError."""

    def __init__(self, data: memoryview, start: int, end: int):
        self.data, self.at, self.end = data, start, end

    def take(self, form: str) -> tuple:
        size = struct.calcsize(form)
        if self.at + size > self.end:
            raise EOFError
        self.at += size
        return struct.unpack_from(form, self.data, self.at - size)

    def skip(self, size: int) -> None:
        self.at += size

    def table(self, rows: int, kind: str, columns: int = 1) -> np.ndarray:
        """Rows of equal numbers; a table that says it is longer than its box is cut off there."""
        width = np.dtype(kind).itemsize * columns
        rows = max(0, min(rows, (self.end - self.at) // width))
        found = np.frombuffer(self.data, kind, rows * columns, self.at).astype(np.int64)
        self.at += rows * width
        return found.reshape(-1, columns) if columns > 1 else found


def _locate(sizes: np.ndarray, chunks: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Byte offset of every sample that a chunk holds, from chunk offsets and the (first chunk, samples) runs of stsc."""
    first = np.clip(runs[:, 0], 1, len(chunks) + 1)
    spans = np.maximum(np.append(first[1:], len(chunks) + 1) - first, 0)
    each = np.repeat(np.clip(runs[:, 1], 0, len(sizes)), spans)
    each = np.diff(np.minimum(np.cumsum(each), len(sizes)), prepend=0)  # no more than there are samples
    chunk = np.repeat(np.arange(len(each)), each)
    before = np.cumsum(sizes) - sizes
    start = np.cumsum(each) - each
    return chunks[chunk] + before[: len(chunk)] - before[np.minimum(start, max(len(sizes) - 1, 0))][chunk]


def _sizes(kind: bytes, body: Box, most: int) -> np.ndarray:
    """Sample sizes of stsz or stz2. A file of ``most`` bytes has no more samples of one size than fit."""
    body.skip(4)
    if kind == b"stsz":
        same, count = body.take(">II")
        return np.full(min(count, most // same), same, np.int64) if same else body.table(count, ">u4")
    bits, count = body.take(">II")
    bits &= 0xFF
    if bits == 4:
        pairs = body.table((count + 1) // 2, ">u1")
        return np.stack([pairs >> 4, pairs & 15], axis=1).ravel()[:count]
    return body.table(count, ">u2" if bits == 16 else ">u1")


def _tables(kind: bytes, body: Box, t: Track, raw: dict, most: int) -> None:
    """Take one box of a track."""
    if kind == b"tkhd":
        (version,) = body.take(">B3x")
        body.skip(16 if version == 1 else 8)
        (t.id,) = body.take(">I")
    elif kind == b"mdhd":
        (version,) = body.take(">B3x")
        body.skip(16 if version == 1 else 8)
        t.timescale, t.duration = body.take(">IQ" if version == 1 else ">II")
    elif kind == b"hdlr":
        body.skip(8)
        t.handler = b"".join(body.take("4c")).decode("latin-1")
    elif kind == b"stsd":
        body.skip(12)
        t.codec = b"".join(body.take("4c")).decode("latin-1").strip()
    elif kind in (b"stsz", b"stz2"):
        raw["sizes"] = _sizes(kind, body, most)
    elif kind in (b"stco", b"co64", b"stsc", b"stss", b"stts"):
        body.skip(4)
        (count,) = body.take(">I")
        raw[kind if kind != b"co64" else b"stco"] = body.table(count, ">u8" if kind == b"co64" else ">u4", {b"stsc": 3, b"stts": 2}.get(kind, 1))


def _finish(t: Track, raw: dict) -> None:
    """Put a track's tables together; a track without some of them has no samples."""
    sizes, chunks, runs = raw.get("sizes", np.zeros(0, np.int64)), raw.get(b"stco"), raw.get(b"stsc")
    if chunks is not None and runs is not None and len(sizes) and len(runs):
        t.offsets = _locate(sizes, chunks, runs)
    t.sizes = sizes[: len(t.offsets)]
    keys = raw[b"stss"] - 1 if b"stss" in raw else np.arange(len(t.sizes))  # without stss every sample is a keyframe
    t.keys = keys[(keys >= 0) & (keys < len(t.sizes))]
    if b"stts" in raw:
        t.duration = int((raw[b"stts"][:, 0] * raw[b"stts"][:, 1]).sum())


def _fragment(boxes: list[tuple[bytes, Box]], moof: int, tracks: dict[int, Track], preset: dict[int, tuple], seen: set[int]) -> None:
    """Take one traf: its samples follow those of its track."""
    t, base, duration, size, flags = None, moof, 0, 0, 0
    next_at = None
    for kind, body in boxes:
        if kind == b"tfhd":
            has, id_ = body.take(">II")
            t = tracks.get(id_)
            duration, size, flags = preset.get(id_, (0, 0, 0))
            if has & 0x1:
                (base,) = body.take(">Q")
            body.skip(4 if has & 0x2 else 0)
            duration = body.take(">I")[0] if has & 0x8 else duration
            size = body.take(">I")[0] if has & 0x10 else size
            flags = body.take(">I")[0] if has & 0x20 else flags
        elif kind == b"trun" and t is not None:
            has, count = body.take(">II")
            has &= 0xFFFFFF
            at = base + body.take(">i")[0] if has & 0x1 else next_at if next_at is not None else base
            first = body.take(">I")[0] if has & 0x4 else None
            names = [n for bit, n in ((0x100, "d"), (0x200, "s"), (0x400, "f"), (0x800, "c")) if has & bit]
            if names:
                rows = body.table(count, ">u4", len(names)).reshape(-1, len(names))
            else:
                rows = np.zeros((min(count, len(body.data) // size if size else 0), 0), np.int64)
            column = {n: rows[:, i] for i, n in enumerate(names)}
            sizes = column.get("s", np.full(len(rows), size, np.int64))
            of = column.get("f", np.full(len(rows), flags, np.int64)).copy()
            if first is not None and len(of):
                of[0] = first
            if t.id not in seen:  # durations of headers do not count fragments
                seen.add(t.id)
                t.duration = t.duration if len(t.sizes) else 0
            t.keys = np.append(t.keys, len(t.sizes) + np.flatnonzero(of & 0x10000 == 0))
            t.offsets = np.append(t.offsets, at + np.cumsum(sizes) - sizes)
            t.sizes = np.append(t.sizes, sizes)
            t.duration += int(column["d"].sum()) if "d" in column else duration * len(rows)
            next_at = at + int(sizes.sum())


def inspect(data: bytes) -> list[Track]:
    """The tracks of a file from its boxes and sample tables alone.

    Boxes that are cut short or say what cannot be are passed over, with what they would have told.
    """
    view = memoryview(data)
    tracks: list[Track] = []
    raws: list[dict] = []
    preset: dict[int, tuple] = {}
    fragments: list[tuple[int, list[tuple[bytes, Box]]]] = []
    moof = 0
    for path, start, end in walk(view):
        kind, body = path[-1], Box(view, start, end)
        if kind == b"trak":
            tracks.append(Track())
            raws.append({})
        elif kind == b"moof":
            moof = start - 8
        elif kind == b"traf":
            fragments.append((moof, []))
        elif b"traf" in path and fragments:
            fragments[-1][1].append((kind, body))
        try:
            if kind == b"trex":
                body.skip(4)
                id_, _, *rest = body.take(">IIIII")
                preset[id_] = tuple(rest)
            elif b"trak" in path and tracks:
                _tables(kind, body, tracks[-1], raws[-1], len(data))
        except EOFError:
            continue
    for t, raw in zip(tracks, raws):
        _finish(t, raw)
    seen: set[int] = set()
    for at, boxes in fragments:
        with contextlib.suppress(EOFError):
            _fragment(boxes, at, {t.id: t for t in tracks}, preset, seen)
    for t in tracks:
        _possible(t)
    return tracks


def _possible(t: Track) -> None:
    """Pass over samples that could lie in no file."""
    fine = (t.offsets >= 0) & (t.offsets < 1 << 62)
    if not fine.all():
        t.keys = (np.cumsum(fine) - 1)[t.keys[fine[t.keys]]]
        t.offsets, t.sizes = t.offsets[fine], t.sizes[fine]


def payload_of(data: bytes, track: Track) -> bytes:
    """The bytes of all samples, in order; neighbours are read as one slice."""
    gaps = np.flatnonzero(track.offsets[1:] != track.offsets[:-1] + track.sizes[:-1]) + 1
    bounds = [0, *gaps, len(track.offsets)]
    return b"".join(data[track.offsets[a] : track.offsets[b - 1] + track.sizes[b - 1]] for a, b in zip(bounds, bounds[1:]) if b > a)


def feature(track: Track) -> str:
    """Codec, duration and keyframes in one line; the ranges are given by their number, ends and a checksum."""
    ranges = track.ranges()
    if not ranges:
        return f"codec={track.codec};handler={track.handler};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes=0"
    sums = zlib.crc32(np.array(ranges, ">u8").tobytes()) & 0xFFFFFFFF
    first, last = (f"{a}-{b}" for a, b in (ranges[0], ranges[-1]))
    return f"codec={track.codec};handler={track.handler};timescale={track.timescale};duration={track.duration};samples={len(track.sizes)};keyframes={len(ranges)};first={first};last={last};ranges_crc32={sums}"


def store(spark: SparkSession, docs: DataFrame, media: bool = True) -> DataFrame:
    """Every whole text of ``docs`` as a media column with what its boxes tell.

    Columns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, codec, timescale,
    duration, keyframes (array of start, end) and media (binary; left out with ``media=False``). A null
    text counts as empty and gives one frame of filling; rows stay as they are, repeated ones too; columns other
    than doc_id and text are not read.
    """
    small_arrow_batches(spark)
    binary = ", media binary" if media else ""
    told = "codec string, timescale long, duration long, keyframes array<struct<start:long,end:long>>"
    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, {told}{binary}"

    def one(doc_id, text) -> dict:
        data = (text or "").encode("utf-8", "surrogatepass")
        stored = pack(pad(data))
        track = inspect(stored)[0]
        back = payload_of(stored, track)
        row = {"doc_id": doc_id, "n_bytes": len(data), "codec": track.codec, "timescale": track.timescale, "duration": track.duration, "keyframes": [{"start": a, "end": b} for a, b in track.ranges()]}
        row |= {"payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]) & 0xFFFFFFFF}
        row |= {"media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(), "feature": feature(track)}
        return row | ({"media": stored} if media else {})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([one(i, t) for i, t in zip(pdf["doc_id"], pdf["text"])])

    return docs.select("doc_id", "text").mapInPandas(run, schema)


TRACK = "array<struct<codec:string,handler:string,timescale:long,duration:long,samples:long,keyframes:array<struct<start:long,end:long>>>>"


def describe(spark: SparkSession, files: DataFrame, column: str = "media") -> DataFrame:
    """``files`` with tracks: what the boxes of the media in a binary column tell, payloads left alone.

    A track has codec, handler, timescale, duration (in that scale), samples and keyframes, the byte ranges of its sync samples in the
    file. Null, empty and foreign bytes have no track; of malformed files there is what can be told. tracks takes the place of
    a column of that name; rows stay as they are.
    """
    small_arrow_batches(spark)

    @F.pandas_udf(TRACK)
    def tracks(media: pd.Series) -> pd.Series:
        row = lambda t: {"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.duration, "samples": len(t.sizes), "keyframes": [{"start": a, "end": b} for a, b in t.ranges()]}
        return pd.Series([[row(t) for t in inspect(bytes(data))] if data is not None else [] for data in media])

    return files.withColumn("tracks", tracks(F.col(column)))
