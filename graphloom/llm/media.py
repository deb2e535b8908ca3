"""ISO base media containers as columns: box walk, sample tables, codec, duration and keyframe byte ranges.

The reader goes through the box tree and the sample tables only; payload bytes are fetched for a range when asked for.
"""

from __future__ import annotations

import contextlib
import hashlib
import struct
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, utf8

#: Fixed values of the format: boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
#: Fixed value of the format: the identity matrix of movie and track headers.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

UNIT, CHUNK, RATE = 64, 4096, 8000


@dataclass
class Track:
    kind: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0
    n_samples: int = 0
    fixed_size: int = 0
    sizes: list[int] = field(default_factory=list)
    chunk_offsets: list[int] = field(default_factory=list)
    runs: list[tuple[int, int]] = field(default_factory=list)  # first chunk, samples in a chunk
    times: list[tuple[int, int]] = field(default_factory=list)  # samples, ticks of each
    sync: list[int] | None = None  # numbers from 1; None: every sample is one

    def chunks(self) -> Iterator[tuple[int, int, int]]:
        """First sample (from 0), sample count and byte offset of each chunk."""
        done, firsts = 0, [first for first, _ in self.runs]
        for k, offset in enumerate(self.chunk_offsets, 1):
            at = bisect_right(firsts, k) - 1
            count = min(self.runs[at][1] if at >= 0 else 0, self.n_samples - done)
            if count <= 0:
                return
            yield done, count, offset
            done += count

    def span(self, first: int, count: int) -> int:
        return count * self.fixed_size if self.fixed_size else sum(self.sizes[first : first + count])

    def byte_ranges(self, keyframes_only: bool = True) -> list[tuple[int, int]]:
        """Byte ranges (start, end) of the wanted samples in file order; ranges that touch are joined."""
        out: list[list[int]] = []

        def add(start: int, end: int) -> None:
            if end > start:
                if out and out[-1][1] == start:
                    out[-1][1] = end
                else:
                    out.append([start, end])

        wanted = None if self.sync is None or not keyframes_only else sorted(self.sync)
        at = 0
        for first, count, offset in self.chunks():
            if wanted is None:
                add(offset, offset + self.span(first, count))
                continue
            here, place = first, offset
            while at < len(wanted) and wanted[at] - 1 < first + count:
                sample = wanted[at] - 1
                place += self.span(here, sample - here)
                add(place, place + self.span(sample, 1))
                place, here = place + self.span(sample, 1), sample + 1
                at += 1
        return [(a, b) for a, b in out]

    def total_ticks(self) -> int:
        return self.duration or sum(n * d for n, d in self.times)


def boxes(data: bytes | memoryview, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, body start and end of each box; a damaged size ends the walk."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def table(data, start: int, end: int, width: int, head: int = 4) -> Iterator[tuple[int, ...]]:
    """Rows of a counted table of 32-bit fields; stops at the end of the box."""
    if start + head + 4 > end:
        return
    count = min(struct.unpack_from(">I", data, start + head)[0], (end - start - head - 4) // (4 * width))
    yield from struct.iter_unpack(f">{width}I", bytes(data[start + head + 4 : start + head + 4 + 4 * width * count]))


def walk(data: bytes | memoryview) -> list[Track]:
    """The tracks of a container. Bytes that are no container give none; what a damaged one still has is kept."""
    tracks: list[Track] = []

    def leaf(kind: bytes, a: int, b: int, t: Track) -> None:
        if kind == b"mdhd":
            t.timescale, t.duration = struct.unpack_from(">IQ", data, a + 20) if data[a] == 1 else struct.unpack_from(">II", data, a + 12)
        elif kind == b"hdlr":
            t.kind = bytes(data[a + 8 : a + 12]).decode("latin-1")
        elif kind == b"stsd":
            t.codec = bytes(data[a + 12 : a + 16]).decode("latin-1")
        elif kind == b"stts":
            t.times = list(table(data, a, b, 2))
        elif kind == b"stss":
            t.sync = [x for (x,) in table(data, a, b, 1)]
        elif kind == b"stsc":
            t.runs = [(first, n) for first, n, _ in table(data, a, b, 3)]
        elif kind == b"stsz":
            t.fixed_size, t.n_samples = struct.unpack_from(">II", data, a + 4)
            t.sizes = [] if t.fixed_size else [x for (x,) in table(data, a, b, 1, 8)]
        elif kind == b"stco":
            t.chunk_offsets = [x for (x,) in table(data, a, b, 1)]
        elif kind == b"co64":
            t.chunk_offsets = [(hi << 32) | lo for hi, lo in table(data, a, b, 2)]

    open_boxes: list[tuple[Iterator[tuple[bytes, int, int]], Track | None]] = [(boxes(data, 0, len(data)), None)]
    while open_boxes:
        inside, track = open_boxes[-1]
        found = next(inside, None)
        if found is None:
            open_boxes.pop()
            continue
        kind, a, b = found
        if kind in CONTAINERS:
            if kind == b"trak":
                track = Track()
                tracks.append(track)
            open_boxes.append((boxes(data, a, b), track))
        elif track is not None:
            with contextlib.suppress(struct.error, IndexError):
                leaf(kind, a, b, track)
    return tracks


def box(kind: bytes, *body: bytes) -> bytes:
    inner = b"".join(body)
    return struct.pack(">I4s", len(inner) + 8, kind) + inner if len(inner) + 8 < 1 << 32 else struct.pack(">I4sQ", 1, kind, len(inner) + 16) + inner


def full_box(kind: bytes, *body: bytes, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", flags), *body)


def audio_file(payload: bytes, rate: int = RATE) -> bytes:
    """A container whose one track is 8-bit mono sound: each payload byte is a sample."""
    n = len(payload)
    whole, rest = divmod(n, CHUNK)
    n_chunks = whole + bool(rest)
    runs = ([(1, CHUNK, 1)] if whole else []) + ([(whole + 1, rest, 1)] if rest else [])
    wide = n + 64 * n_chunks + 4096 >= 1 << 32

    def movie(first: int) -> bytes:
        offsets = struct.pack(f">{n_chunks}{'Q' if wide else 'I'}", *range(first, first + n_chunks * CHUNK, CHUNK))
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, (rate & 0xFFFF) << 16))
        samples = box(
            b"stbl",
            full_box(b"stsd", struct.pack(">I", 1), entry),
            full_box(b"stts", struct.pack(">III", 1, n, 1)),
            full_box(b"stsc", struct.pack(">I", len(runs)), b"".join(struct.pack(">III", *r) for r in runs)),
            full_box(b"stsz", struct.pack(">II", 1, n)),
            full_box(b"co64" if wide else b"stco", struct.pack(">I", n_chunks), offsets),
        )
        info = box(b"minf", full_box(b"smhd", bytes(4)), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), samples)
        media = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"soun", bytes(13)), info)
        track = box(b"trak", full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), flags=3), media)
        head = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", head, track)

    kind = box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")
    data_head = 16 if n + 8 >= 1 << 32 else 8
    return kind + movie(len(kind) + len(movie(0)) + data_head) + box(b"mdat", payload)


def describe(tracks: list[Track]) -> str:
    """Codec, rate, sample and tick counts, and keyframe byte ranges of each track."""
    out = []
    for t in tracks:
        keys = t.n_samples if t.sync is None else len(t.sync)
        ranges = ",".join(f"{a}-{b}" for a, b in t.byte_ranges())
        seconds = t.total_ticks() / t.timescale if t.timescale else 0.0
        out.append(f"kind={t.kind};codec={t.codec.strip()};timescale={t.timescale};samples={t.n_samples};duration_s={seconds:.6f};keyframes={keys};ranges={ranges}")
    return "|".join(out)


COLUMNS = "n_tracks int, codec string, duration_s double, n_samples long, n_keyframes long, keyframe_ranges array<struct<start:long,end:long>>"


def media_columns(df: DataFrame, id_col: str, content_col: str) -> DataFrame:
    """Describes each media file without decoding payloads.

    One row per input row: the id, then COLUMNS of the first track. Null content or bytes that are no container
    give n_tracks 0 and nulls, and a damaged one what is left of it, however deep its boxes; files count whole, however
    long; repeated rows stay repeated; other columns are not looked at; an empty table gives an empty table.
    """
    src = df.selectExpr(f"`{id_col}` AS media_id", f"cast(`{content_col}` AS binary) AS content")
    schema = "media_id " + src.schema["media_id"].dataType.simpleString() + ", " + COLUMNS

    def run(batches):
        for batch in batches:
            rows = []
            for data in batch.column(1).to_pylist():
                tracks = walk(data or b"")
                t = tracks[0] if tracks else None
                rows.append(
                    {"n_tracks": len(tracks), "codec": t.codec.strip() if t else None, "duration_s": t.total_ticks() / t.timescale if t and t.timescale else None, "n_samples": t.n_samples if t else None}
                    | {"n_keyframes": (t.n_samples if t.sync is None else len(t.sync)) if t else None, "keyframe_ranges": [{"start": a, "end": b} for a, b in t.byte_ranges()] if t else None}
                )
            kinds = [("n_tracks", pa.int32()), ("codec", pa.string()), ("duration_s", pa.float64()), ("n_samples", pa.int64()), ("n_keyframes", pa.int64()), ("keyframe_ranges", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], kind) for k, kind in kinds)], ["media_id", *(k for k, _ in kinds)])

    return arrow_map(src, run, schema).withColumnRenamed("media_id", id_col)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text as sound samples in a container, reads the stored bytes back and digests them.

    One row per document: id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    Null text counts as empty and gives one block of 64 zero bytes. Texts are stored whole, as their bytes stand.
    Repeated rows stay repeated; other columns are not looked at; an empty table stays empty.
    """
    src = docs.selectExpr(f"`{id_col}` AS doc_id", f"cast(`{text_col}` AS string) AS text")
    schema = f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def row(text: bytes | None) -> tuple:
        text = text or b""
        media = audio_file(text + bytes(max(UNIT, -(-len(text) // UNIT) * UNIT) - len(text)))
        view = memoryview(media)
        tracks = walk(view)
        back = b"".join(view[a:b] for a, b in tracks[0].byte_ranges(keyframes_only=False))
        return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe(tracks)

    def run(batches):
        for batch in batches:
            cols = list(zip(*map(row, utf8(batch.column(1))), strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return arrow_map(src, run, schema).withColumnRenamed("doc_id", id_col)
