"""Operator 1: ISO media containers as columns.

``parse`` walks the nested boxes of a file, decodes its sample tables and the
runs of its fragments, and gives codec, duration and the byte ranges of
keyframes; payload bytes are never decoded. ``wrap`` stores bytes losslessly as 8-bit grey samples in such
a file, one 64-byte (8 x 8) picture a sample.

Defined results: a null media value has no tracks and no error; a truncated
or malformed file has the tracks that could be read and ``error`` set, and
what its counts claim is never allocated before it fits the file; sizes of 0
(box runs to the end) and 64-bit sizes are followed, boxes are walked to any
depth. A track's samples are those of its tables, then those of its fragments.
Repeated rows are handled one by one, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map

SAMPLE_BYTES = 64
SIDE = 8
TIMESCALE = 1000
SAMPLE_TICKS = 40
KEYFRAME_EVERY = 16
SAMPLES_PER_CHUNK = 32
#: Boxes that only hold other boxes.
PARENTS = frozenset({b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf", b"udta", b"mvex", b"moof", b"traf"})
#: Largest number that a column of the result holds.
LARGEST = 2**63 - 1
#: Identity matrix of the format's headers, 16.16 and 2.30 fixed point.
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)

TRACK = "struct<track_id:long,handler:string,codec:string,width:int,height:int,timescale:long,duration:long,n_samples:long,media_bytes:long,keyframes:array<struct<offset:long,size:long>>>"


# --- writing ---------------------------------------------------------------


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def full_box(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """``data`` with zero bytes up to a positive multiple of the sample size."""
    return data + bytes(-len(data) % SAMPLE_BYTES or (0 if data else SAMPLE_BYTES))


def wrap(payload: bytes) -> bytes:
    """A container with one grey 8-bit video track whose samples are ``payload``."""
    if not payload or len(payload) % SAMPLE_BYTES:
        raise ValueError("the payload must be a positive multiple of the sample size")
    n = len(payload) // SAMPLE_BYTES
    chunks = -(-n // SAMPLES_PER_CHUNK)
    ticks = n * SAMPLE_TICKS
    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2mp41")
    first = len(brand) + 16  # mdat with a 64-bit size
    media = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) + payload
    entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 8, -1))
    sync = np.arange(1, n + 1, KEYFRAME_EVERY, dtype=">u4")
    last = n - (chunks - 1) * SAMPLES_PER_CHUNK
    runs = [(1, SAMPLES_PER_CHUNK, 1)] if chunks > 1 else []
    if not runs or last != SAMPLES_PER_CHUNK:
        runs.append((chunks, last, 1))
    offsets = first + np.arange(chunks, dtype=">u8") * (SAMPLES_PER_CHUNK * SAMPLE_BYTES)
    tables = box(
        b"stbl",
        full_box(b"stsd", struct.pack(">I", 1), entry),
        full_box(b"stts", struct.pack(">III", 1, n, SAMPLE_TICKS)),
        full_box(b"stss", struct.pack(">I", len(sync)), sync.tobytes()),
        full_box(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
        full_box(b"stsz", struct.pack(">II", SAMPLE_BYTES, n)),
        full_box(b"co64", struct.pack(">I", chunks), offsets.astype(">u8").tobytes()),
    )
    minf = box(b"minf", full_box(b"vmhd", bytes(8), flags=1), box(b"dinf", full_box(b"dref", struct.pack(">I", 1), full_box(b"url ", flags=1))), tables)
    mdia = box(b"mdia", full_box(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0)), full_box(b"hdlr", bytes(4), b"vide", bytes(12), b"\0"), minf)
    tkhd = full_box(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(16), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3)
    mvhd = full_box(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
    return brand + media + box(b"moov", mvhd, box(b"trak", tkhd, mdia))


# --- reading ---------------------------------------------------------------


def walk(data: bytes) -> Iterator[tuple[bytes, int, int, int]]:
    """(kind, first byte of the box, first byte of its body, end), parents before their children."""
    ends, start = [len(data)], 0
    while ends:
        end = ends[-1]
        if start + 8 > end:
            if start != end:
                raise ValueError("bytes are left over after the last box")
            ends.pop()
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                raise ValueError("a box header is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} reaches past its parent")
        yield kind, start, start + head, start + size
        if kind in PARENTS:
            ends.append(start + size)
            start += head
        else:
            start += size


def _table(data: bytes, at: int, end: int, dtype: str, columns: int = 1) -> np.ndarray:
    """A counted table after version, flags and count."""
    (n,) = struct.unpack_from(">I", data, at + 4)
    width = np.dtype(dtype).itemsize * columns
    if at + 8 + n * width > end:
        raise ValueError("a sample table is cut off")
    return np.frombuffer(data, dtype, n * columns, at + 8).reshape(-1, columns).astype(np.int64)


def _repeated(value: int, n: int, room: int) -> np.ndarray:
    """``n`` samples of ``value`` bytes, which must fit into ``room`` bytes (of empty ones, no more than ``room``)."""
    if n * max(value, 1) > room:
        raise ValueError("there are more samples than bytes")
    return np.full(n, value, np.int64)


def _sizes(data: bytes, at: int, end: int, compact: bool) -> np.ndarray:
    if not compact:
        same, n = struct.unpack_from(">II", data, at + 4)
        if same:
            return _repeated(same, n, len(data))
        if at + 12 + 4 * n > end:
            raise ValueError("a sample table is cut off")
        return np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
    bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
    if bits not in (4, 8, 16) or at + 12 + (n * bits + 7) // 8 > end:
        raise ValueError("a sample table is cut off")
    if bits == 4:
        raw = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
        return np.stack([raw >> 4, raw & 15], 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(data, ">u2" if bits == 16 else np.uint8, n, at + 12).astype(np.int64)


def sample_ranges(tables: dict[bytes, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Offset and size of every sample, from the chunk tables."""
    size, runs, chunk = tables[b"size"], tables[b"stsc"], tables[b"chunk"][:, 0]
    if not len(size):
        return size, size
    if not len(runs) or not len(chunk) or runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any():
        raise ValueError("the chunk runs are out of order")
    ends = np.minimum(np.append(runs[1:, 0], len(chunk) + 1), len(chunk) + 1)
    # a chunk holds no more samples than there are, so sums stay small
    per_chunk = np.repeat(np.minimum(runs[:, 1], len(size)), np.maximum(0, ends - runs[:, 0]))
    held = np.cumsum(per_chunk)
    if not len(held) or held[-1] < len(size):
        raise ValueError("there are more samples than chunks hold")
    of = np.searchsorted(held, np.arange(len(size)), "right")
    before = np.cumsum(size) - size
    first = np.append(0, held)[of]
    return chunk[of] + before - before[first], size


class Fragments:
    """Samples of movie fragments, by track."""

    def __init__(self, data: bytes):
        self.data = data
        self.defaults: dict[int, tuple[int, int, int]] = {}  # trex: duration, size, flags
        self.samples: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]] = {}  # offset, size, sync, ticks
        self.moof = self.next = 0
        self.track: int | None = None

    def trex(self, at: int) -> None:
        track, _, *rest = struct.unpack_from(">5I", self.data, at + 4)
        self.defaults[track] = tuple(rest)

    def begin(self, start: int) -> None:
        self.moof = self.next = start

    def tfhd(self, at: int) -> None:
        flags, self.track = struct.unpack_from(">II", self.data, at)
        flags &= 0xFFFFFF
        self.now = list(self.defaults.get(self.track, (0, 0, 0)))
        at += 8
        self.base = self.moof if flags & 0x20000 else self.next
        if flags & 1:
            self.base = struct.unpack_from(">Q", self.data, at)[0]
            at += 8
        at += 4 if flags & 2 else 0
        for k in range(3):
            if flags & 8 << k:
                self.now[k] = struct.unpack_from(">I", self.data, at)[0]
                at += 4
        self.next = self.base

    def trun(self, at: int, end: int) -> None:
        if self.track is None:
            raise ValueError("a run has no fragment header")
        flags, n = struct.unpack_from(">II", self.data, at)
        flags &= 0xFFFFFF
        at += 8
        if flags & 1:
            self.next = self.base + struct.unpack_from(">i", self.data, at)[0]
            at += 4
        first = None
        if flags & 4:
            first = struct.unpack_from(">I", self.data, at)[0]
            at += 4
        fields = [k for k in range(4) if flags & 0x100 << k]
        if at + 4 * len(fields) * n > end:
            raise ValueError("a run of samples is cut off")
        table = np.frombuffer(self.data, ">u4", len(fields) * n, at).reshape(n, len(fields)).astype(np.int64) if fields else None
        duration, size, flag = (table[:, fields.index(k)] if k in fields else None for k in range(3))
        ticks = int(duration.sum()) if duration is not None else n * self.now[0]
        if size is None:
            size = _repeated(self.now[1], n, len(self.data))
        sync = (flag if flag is not None else np.full(n, self.now[2], np.int64)) & 0x10000 == 0
        if first is not None and n:
            sync = sync.copy()
            sync[0] = first & 0x10000 == 0
        offset = self.next + np.cumsum(size) - size
        self.next += int(size.sum())
        if n and (offset[0] < 0 or self.next > len(self.data)):
            raise ValueError("a sample lies past the end")
        self.samples.setdefault(self.track, []).append((offset, size, sync, ticks))


def parse(data: bytes | None) -> tuple[list[dict], str | None]:
    """The tracks of a file, and what is wrong with it if anything is."""
    tracks: list[dict] = []
    now: dict = {}
    error = None

    def close() -> None:
        if not now:
            return
        t, done = now["tables"], dict(now)
        now.clear()
        if not {b"size", b"stsc", b"chunk"} <= t.keys():
            raise ValueError("a track has no sample tables")
        offset, size = sample_ranges(t)
        if len(offset) and (int(offset.min()) < 0 or int(offset.max()) > len(data) or int((offset + size).max()) > len(data)):
            raise ValueError("a sample lies past the end")
        key = t[b"stss"][:, 0] - 1 if b"stss" in t else np.arange(len(size))
        if len(key) and not (0 <= key.min() and key.max() < len(size)):
            raise ValueError("a keyframe has no sample")
        done["offset"], done["size"], done["key"] = offset, size, key
        if b"stts" in t and not done["duration"]:
            done["duration"] = sum(a * b for a, b in t[b"stts"].tolist())
        if (done["duration"] or 0) > LARGEST:
            raise ValueError("a duration is out of range")
        tracks.append(done)

    fragments, inside = Fragments(data or b""), 0
    try:
        for kind, start, at, end in walk(data or b""):
            if start >= inside:
                close()
            if kind == b"trak":
                close()
                inside = end
                now.update(track_id=None, handler=None, codec=None, width=None, height=None, timescale=None, duration=None, tables={})
            elif kind == b"trex":
                fragments.trex(at)
            elif kind == b"moof":
                fragments.begin(start)
            elif kind == b"tfhd":
                fragments.tfhd(at)
            elif kind == b"trun":
                fragments.trun(at, end)
            elif not now:
                continue
            elif kind == b"tkhd":
                now["track_id"] = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
            elif kind == b"mdhd":
                now["timescale"], now["duration"] = struct.unpack_from(">IQ" if data[at] else ">II", data, at + (20 if data[at] else 12))
            elif kind == b"hdlr":
                now["handler"] = data[at + 8 : at + 12].decode("latin-1")
            elif kind == b"stsd" and struct.unpack_from(">I", data, at + 4)[0]:
                now["codec"] = data[at + 12 : at + 16].decode("latin-1").rstrip()
                if now["handler"] == "vide":
                    now["width"], now["height"] = struct.unpack_from(">HH", data, at + 40)
            elif kind in (b"stts", b"stsc", b"stss"):
                now["tables"][kind] = _table(data, at, end, ">u4", {b"stts": 2, b"stsc": 3, b"stss": 1}[kind])
            elif kind in (b"stco", b"co64"):
                now["tables"][b"chunk"] = _table(data, at, end, ">u4" if kind == b"stco" else ">u8")
            elif kind in (b"stsz", b"stz2"):
                now["tables"][b"size"] = _sizes(data, at, end, kind == b"stz2")
        close()
    except (ValueError, struct.error, IndexError) as e:
        error = str(e)
    for t in tracks:
        add_fragments(t, fragments.samples.pop(t["track_id"], []))
    if fragments.samples and error is None:
        error = "a fragment belongs to no track"
    return tracks, error


def add_fragments(track: dict, runs: list) -> None:
    """Append the samples of a track's fragments; its duration grows by theirs where its header leaves it out."""
    if not runs:
        return
    offset, size, sync, ticks = zip(*runs)
    before = len(track["size"])
    track["key"] = np.concatenate([track["key"], before + np.flatnonzero(np.concatenate(sync))])
    track["offset"], track["size"] = np.concatenate([track["offset"], *offset]), np.concatenate([track["size"], *size])
    if not track["duration"]:
        track["duration"] = min(sum(ticks), LARGEST)


def payload(data: bytes, track: dict) -> bytes:
    """The stored bytes of a track's samples, in order; neighbouring samples are read together."""
    offset, size = track["offset"], track["size"]
    if not len(offset):
        return b""
    starts = np.flatnonzero(np.append(True, offset[1:] != offset[:-1] + size[:-1]))
    ends = np.append(starts[1:], len(offset)) - 1
    return b"".join(data[offset[a] : offset[b] + size[b]] for a, b in zip(starts, ends))


def track_row(track: dict) -> tuple:
    key = track["key"]
    frames = list(zip(track["offset"][key].tolist(), track["size"][key].tolist()))
    return (*(track[k] for k in ("track_id", "handler", "codec", "width", "height", "timescale", "duration")), len(track["size"]), int(track["size"].sum()), frames)


def media_columns(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """(key, tracks, error) for each row's container; the files' payloads are not decoded."""

    def rows(keys, files):
        for k, data in zip(keys, files):
            tracks, error = parse(data)
            yield k, [dict(zip(("track_id", "handler", "codec", "width", "height", "timescale", "duration", "n_samples", "media_bytes", "keyframes"), (*track_row(t)[:-1], [{"offset": o, "size": s} for o, s in track_row(t)[-1]]))) for t in tracks], error

    source = media.select(F.col(key).alias("key"), F.col(column).alias("media"))
    kind = media.schema[key].dataType.simpleString()
    return arrow_map(source, rows, f"key {kind}, tracks array<{TRACK}>, error string", chunk=64).withColumnRenamed("key", key)


def store_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text, null as empty, stored in a container."""

    def rows(ids, texts):
        for i, text in zip(ids, texts):
            data = (text or "").encode()
            yield i, len(data), wrap(pad(data))

    return arrow_map(documents.select("doc_id", "text"), rows, "doc_id long, n_bytes long, media binary", chunk=128)


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and features of stored media (doc_id, n_bytes, media), all read back from the file.

    ``feature`` is codec, size, duration in seconds, sample count and keyframe
    ranges; ranges of equal length and distance are written as
    first+step*count/size, which is lossless.
    """

    def rows(ids, lengths, files):
        for i, n, data in zip(ids, lengths, files):
            tracks, error = parse(data)
            if error or len(tracks) != 1:
                raise ValueError(error or "one track was stored")
            (track,) = tracks
            held = payload(data, track)
            yield i, n, len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-SAMPLE_BYTES:]), len(data), hashlib.sha256(data).hexdigest(), feature(track), len(track["key"])

    return arrow_map(stored, rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_keyframes long", chunk=128)


def feature(track: dict) -> str:
    at, size = track["offset"][track["key"]], track["size"][track["key"]]
    runs = []
    i = 0
    while i < len(at):
        j = i + 1
        step = int(at[j] - at[i]) if j < len(at) else 0
        while j < len(at) and at[j] - at[j - 1] == step and size[j] == size[i]:
            j += 1
        runs.append(f"{at[i]}+{step}*{j - i}/{size[i]}" if j > i + 1 else f"{at[i]}/{size[i]}")
        i = j
    return f"codec={track['codec']};size={track['width']}x{track['height']};seconds={track['duration'] / track['timescale']:.3f};samples={len(track['size'])};keyframes={','.join(runs)}"


def query(spark, sf_dir: str) -> DataFrame:
    """Every document stored in a container, read back and described."""
    from .common import read_table

    return media_features(store_texts(read_table(spark, sf_dir, "documents")))
