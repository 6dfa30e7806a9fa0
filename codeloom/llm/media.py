"""Operator 5: payloads in ISO media containers.

A text's UTF-8 bytes, padded with 255 to a positive multiple of 576, become the samples of one 8-bit track: ftyp, moov (mvhd,
trak with tkhd, mdhd, hdlr, smhd, dinf, and the sample tables stsd, stts, stss, stsc, stsz, stco), mdat. Samples are frames of
576 units, grouped into chunks of CHUNK; every KEY-th is a keyframe. Reading walks the nested boxes, decodes the tables into a
byte range for each sample, and derives codec, duration and keyframe ranges from the tables alone, without the payload's bytes.
All tracks are read, from the sample tables (stsz or stz2, stco or co64) and from movie fragments (moof, traf, trun).

Null text counts as empty (one frame of padding); equal texts give equal containers, also in repeated rows; texts of any length are
held one at a time; an empty table gives no rows; extra columns are not read. A container without tracks, null or empty has an empty
list of tracks; one whose boxes are broken has null, with the reason beside it.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm._shared import map_texts

FRAME, RATE, CHUNK, KEY, CODEC = 576, 48_000, 8, 16, b"raw "
_NEST = {b"moov", b"trak", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf"}
_MATRIX = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def payload(text: str | None) -> tuple[bytes, int]:
    """The padded payload and the number of bytes before padding."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(1, -(-len(raw) // FRAME)) * FRAME, b"\xff"), len(raw)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _table(kind: bytes, rows: np.ndarray) -> bytes:
    return full(kind, struct.pack(">I", len(rows)), np.asarray(rows, ">u4").tobytes())


def store(data: bytes) -> bytes:
    """A container whose mdat holds data (a positive multiple of FRAME bytes)."""
    frames, units = len(data) // FRAME, len(data)
    starts = np.arange(0, frames, CHUNK)
    in_chunk = np.minimum(CHUNK, frames - starts)
    new = np.flatnonzero(np.append(True, in_chunk[1:] != in_chunk[:-1]))  # stsc has a row where the count changes
    entry = box(CODEC, b"\0" * 6, struct.pack(">H", 1), struct.pack(">HHIHHHHI", 0, 0, 0, 1, 8, 0, 0, RATE << 16 & 0xFFFFFFFF))
    head = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp42")
    # 64-bit places where 32 do not reach
    wide = units > 0xF0000000

    def moov(base: int) -> bytes:
        places = base + starts * FRAME
        chunks = full(b"co64", struct.pack(">I", len(places)), places.astype(">u8").tobytes()) if wide else _table(b"stco", places)
        tables = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            _table(b"stts", np.array([[frames, FRAME]])),
            _table(b"stss", np.arange(1, frames + 1, KEY)),
            _table(b"stsc", np.stack([new + 1, in_chunk[new], np.ones_like(new)], 1)),
            full(b"stsz", struct.pack(">II", FRAME, frames)),
            chunks,
        )
        info = box(b"minf", full(b"smhd", b"\0" * 4), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), tables)
        media = box(b"mdia", full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, units, 0x55C4, 0), version=1), full(b"hdlr", b"\0" * 4, b"soun", b"\0" * 12, b"\0"), info)
        track = box(b"trak", full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, units), b"\0" * 8, struct.pack(">HHHH", 0, 0, 0x100, 0), _MATRIX, b"\0" * 8, version=1, flags=3), media)
        return box(b"moov", full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, units, 0x10000, 0x100), b"\0" * 10, _MATRIX, b"\0" * 24, struct.pack(">I", 2), version=1), track)

    top = struct.pack(">I4sQ", 1, b"mdat", 16 + units) if wide else struct.pack(">I4s", 8 + units, b"mdat")
    return head + moov(len(head) + len(moov(0)) + len(top)) + top + data


def boxes(data: bytes, at: int, end: int):
    """(kind, body start, body end) of the boxes in a range, those nested inside included."""
    while at + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        elif size == 0:
            size = end - at
        if size < body - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} leaves its parent")
        yield kind, body, at + size
        if kind in _NEST:
            yield from boxes(data, body, at + size)
        at += size


@dataclass
class Track:
    codec: str
    timescale: int
    duration: int
    units: int  # by the time-to-sample table
    starts: np.ndarray
    sizes: np.ndarray
    keys: np.ndarray  # numbers of keyframes, from 0

    def read(self, data: bytes) -> bytes:
        return b"".join([data[a : a + n] for a, n in zip(self.starts.tolist(), self.sizes.tolist(), strict=True)])


def _rows(data: bytes, at: int, width: int, dtype: str = ">u4") -> np.ndarray:
    """The rows of a table whose box body begins at `at`: version and flags, number of rows, rows."""
    n = struct.unpack_from(">I", data, at + 4)[0]
    return np.frombuffer(data, dtype, n * width, at + 8).astype(np.int64).reshape(n, width)


def _sizes(data: bytes, found: dict[bytes, int]) -> np.ndarray:
    if b"stz2" in found:  # 4, 8 or 16 bits a size
        at = found[b"stz2"]
        bits, n = struct.unpack_from(">BI", data, at + 7)
        if bits != 4:
            return np.frombuffer(data, f">u{bits // 8}", n, at + 12).astype(np.int64)
        pairs = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
        return np.stack([pairs >> 4, pairs & 15], 1).ravel()[:n].astype(np.int64)
    at = found[b"stsz"]
    each, n = struct.unpack_from(">II", data, at + 4)
    return np.full(n, each, np.int64) if each else np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)


def _track(data: bytes, found: dict[bytes, int]) -> Track:
    """A track's tables; found: where the bodies of its boxes begin."""
    at = found[b"stsd"]
    codec = data[at + 12 : at + 16].decode("latin-1")
    at = found[b"mdhd"]
    timescale, duration = struct.unpack_from(">IQ", data, at + 20) if data[at] else struct.unpack_from(">II", data, at + 12)
    times = _rows(data, found[b"stts"], 2)
    sizes = _sizes(data, found)
    n = len(sizes)
    places = _rows(data, found[b"co64"], 1, ">u8")[:, 0] if b"co64" in found else _rows(data, found[b"stco"], 1)[:, 0]
    runs = _rows(data, found[b"stsc"], 3)
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(places) + 1)))
    chunk = np.repeat(np.arange(len(places)), per)[:n]
    before = np.cumsum(sizes) - sizes
    first = np.cumsum(per) - per
    starts = places[chunk] + before - before[np.minimum(first, n - 1)][chunk] if n else np.zeros(0, np.int64)
    keys = _rows(data, found[b"stss"], 1)[:, 0] - 1 if b"stss" in found else np.arange(n)
    return Track(codec, timescale, duration, int((times[:, 0] * times[:, 1]).sum()), starts, sizes, keys)


#: Flags of tfhd and trun that put a field into the box, in the order of the fields; bit of a sample's flags: no keyframe.
_TFHD = ((0x1, "base", "Q"), (0x2, "entry", "I"), (0x8, "length", "I"), (0x10, "size", "I"), (0x20, "flags", "I"))
_TRUN = ((0x1, "offset", "i"), (0x4, "first", "I"))
_SAMPLE = ((0x100, "length"), (0x200, "size"), (0x400, "flags"), (0x800, "shift"))
_NO_KEY = 0x10000


def _fields(data: bytes, at: int, flags: int, known: tuple) -> tuple[dict[str, int], int]:
    got = {}
    for flag, name, kind in known:
        if flags & flag:
            (got[name],) = struct.unpack_from(">" + kind, data, at)
            at += struct.calcsize(">" + kind)
    return got, at


def _fragments(data: bytes, found: list[tuple[bytes, int, int]], tracks: dict[int, Track]) -> None:
    """Adds the samples of the movie fragments to their tracks. Without a place of its own a run follows the one before it."""
    usual = {}
    for kind, at, _ in found:
        if kind == b"trex":
            track, _, length, size, flags = struct.unpack_from(">5I", data, at + 4)
            usual[track] = {"length": length, "size": size, "flags": flags}
    moof = base = place = 0
    track, given = None, {}
    for kind, at, _ in found:
        if kind == b"moof":
            moof = place = at - 8
            base = moof
        elif kind == b"tfhd":
            (number,) = struct.unpack_from(">I", data, at + 4)
            got, _ = _fields(data, at + 8, struct.unpack_from(">I", data, at)[0] & 0xFFFFFF, _TFHD)
            track, given = tracks[number], usual.get(number, {}) | got
            if "base" in got:
                base = place = got["base"]
            elif struct.unpack_from(">I", data, at)[0] & 0x20000:
                base = moof
        elif kind == b"trun":
            flags, n = struct.unpack_from(">II", data, at)
            got, at = _fields(data, at + 8, flags, _TRUN)
            columns = [name for flag, name in _SAMPLE if flags & flag]
            table = np.frombuffer(data, ">u4", n * len(columns), at).astype(np.int64).reshape(n, len(columns))
            column = {name: table[:, i] for i, name in enumerate(columns)}
            length, size, marks = (column.get(name, np.full(n, given.get(name, 0), np.int64)) for name in ("length", "size", "flags"))
            if "first" in got and n:
                marks = np.append(got["first"], marks[1:])
            place = base + got["offset"] if "offset" in got else place
            ends = place + np.cumsum(size)
            track.keys = np.append(track.keys, len(track.sizes) + np.flatnonzero(marks & _NO_KEY == 0))
            track.starts, track.sizes = np.append(track.starts, ends - size), np.append(track.sizes, size)
            track.units += int(length.sum())
            place = int(ends[-1]) if n else place


def parse(data: bytes) -> list[Track]:
    """The tables of all tracks, in their order; the payload is not touched."""
    found = list(boxes(data, 0, len(data)))
    tracks: dict[int, Track] = {}
    for kind, at, end in found:
        if kind == b"trak":
            inside: dict[bytes, int] = {}
            for k, a, _ in boxes(data, at, end):
                inside.setdefault(k, a)
            head = inside[b"tkhd"]
            (number,) = struct.unpack_from(">I", data, head + (20 if data[head] else 12))
            tracks[number] = _track(data, inside)
    if any(kind == b"moof" for kind, _, _ in found):
        _fragments(data, found, tracks)
    return list(tracks.values())


def _ranges(track: Track) -> list[dict[str, int]]:
    starts = track.starts[track.keys]
    return [{"start": a, "end": b} for a, b in zip(starts.tolist(), (starts + track.sizes[track.keys]).tolist(), strict=True)]


_KEYFRAMES = "keyframes array<struct<start: long, end: long>>"


def tracks(docs: DataFrame, column: str = "media") -> DataFrame:
    """doc_id, tracks (codec, timescale, duration, samples, keyframes with start and end byte of each) and error, of the containers
    in a binary column. Duration is the media header's, or in fragmented files, where that is 0, the samples'."""

    def make():
        def f(doc_ids, _, held):
            out: dict[str, list] = {"doc_id": doc_ids, "tracks": [], "error": []}
            for data in held:
                try:
                    got, error = [{"codec": t.codec, "timescale": t.timescale, "duration": t.duration or t.units, "samples": len(t.sizes), "keyframes": _ranges(t)} for t in parse(data or b"")], None
                except (ValueError, KeyError, IndexError, struct.error) as e:
                    got, error = None, f"{type(e).__name__}: {e}"
                out["tracks"].append(got)
                out["error"].append(error)
            return out

        return f

    # slices are bounded by the bytes of the second column
    rows = docs.select("doc_id", F.col(column).alias("text"), F.col(column).alias("held"))
    return map_texts(rows, f"doc_id long, tracks array<struct<codec: string, timescale: long, duration: long, samples: long, {_KEYFRAMES}>>, error string", make, "held")


def media(docs: DataFrame, with_media: bool = True) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, codec, duration, timescale, keyframes
    (start and end byte of each) and, if with_media, the container."""

    def make():
        def f(doc_ids, texts):
            out: dict[str, list] = {}
            for doc, text in zip(doc_ids, texts, strict=True):
                data, n = payload(text)
                held = store(data)
                (track,) = parse(held)
                back = track.read(held)
                row = {"doc_id": doc, "n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(held), "media_sha256": hashlib.sha256(held).hexdigest(), "codec": track.codec, "duration": track.duration, "timescale": track.timescale, "keyframes": _ranges(track)}
                for k, v in (row | ({"media": held} if with_media else {})).items():
                    out.setdefault(k, []).append(v)
            return out or None

        return f

    return map_texts(docs, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration long, timescale long, " + _KEYFRAMES + ", media binary" * with_media, make)
