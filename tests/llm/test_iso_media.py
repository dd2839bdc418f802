import hashlib
import struct
import zlib

import numpy as np
import pytest

from granary.llm import iso_media as m


def test_round_trip_of_payloads():
    rng = np.random.default_rng(1)
    for n in (0, 1, 191, 192, 193, 192 * 12, 192 * 12 + 1, 100_000):
        payload = m.padded(rng.integers(0, 256, n, np.uint8).tobytes())
        assert len(payload) == max(192, -(-n // 192) * 192)
        media = m.mux(payload)
        (track,) = m.index_file(media)
        assert m.sample_bytes(media, track) == payload
        assert (track.codec, track.handler, track.timescale, track.duration) == ("raw ", "vide", 25, len(payload) // 192)
        assert track.sync.sum() == -(-len(track.sizes) // 12)
        first = track.offsets[track.sync][0]
        assert media[first : first + 192] == payload[:192]


def _atom(kind, body):
    return struct.pack(">I4s", len(body) + 8, kind) + body


def test_fragmented_file_and_compact_sizes():
    stbl = _atom(b"stbl", _atom(b"stsd", bytes(7) + b"\x01" + _atom(b"avc1", bytes(8))) + _atom(b"stz2", struct.pack(">IBBBBI", 0, 0, 0, 0, 4, 3) + b"\x12\x30") + _atom(b"stsc", struct.pack(">IIIII", 0, 1, 1, 3, 1)) + _atom(b"stco", struct.pack(">III", 0, 1, 0)))
    mdia = _atom(b"mdia", _atom(b"mdhd", struct.pack(">IIIIII", 0, 0, 0, 1000, 7, 0)) + _atom(b"hdlr", bytes(8) + b"vide" + bytes(12)) + _atom(b"minf", stbl))
    moov = _atom(b"moov", _atom(b"trak", _atom(b"tkhd", struct.pack(">IIIII", 0, 0, 0, 9, 0)) + mdia) + _atom(b"mvex", _atom(b"trex", struct.pack(">6I", 0, 9, 1, 40, 0, 0x10000))))
    trun = _atom(b"trun", struct.pack(">IIiIII", 0x205, 2, 100, 0, 5, 6))
    moof = _atom(b"moof", _atom(b"traf", _atom(b"tfhd", struct.pack(">II", 0x20000, 9)) + trun))
    data = moov + moof + bytes(200)
    (t,) = m.index_file(data)
    assert t.codec == "avc1" and t.sizes.tolist() == [1, 2, 3, 5, 6]
    assert t.offsets.tolist() == [0, 1, 3, len(moov) + 100, len(moov) + 105]
    assert t.sync.tolist() == [True, True, True, True, False] and t.duration == 7 + 80


@pytest.mark.parametrize("bad", [b"", b"abc", b"\x00\x00\x00\x04moov", struct.pack(">I4s", 900, b"moov"), struct.pack(">I4s", 8, b"moov"), m.mux(m.padded(b"x" * 999))[:-50]])
def test_broken_files_raise_broken_media(bad):
    with pytest.raises(m.BrokenMedia):
        m.index_file(bad)


def test_spark_operators(spark):
    rows = [(1, "héllo", "x"), (2, None, "x"), (3, "", "y"), (1, "héllo", "x"), (None, "a" * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, media string")
    got = m.text_media(df, "doc_id", "text").collect()
    assert len(got) == 5
    for r, (k, text, _) in zip(sorted(got, key=lambda r: (r.n_bytes, str(r.doc_id))), sorted(rows, key=lambda r: (len((r[1] or "").encode()), str(r[0]))), strict=True):
        payload = m.padded((text or "").encode())
        assert (r.doc_id, r.payload_sha256, r.tail_crc32) == (k, hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        media = m.mux(payload)
        assert len(r.keyframes) == r.n_keyframes == -(-len(payload) // (192 * 12))
        assert all(media[f.offset : f.offset + f.size] == payload[i * 192 * 12 :][:192] for i, f in enumerate(r.keyframes))
    files = m.media_column(df, "doc_id", "text")
    index = m.media_index(files, "doc_id", "media").collect()
    assert len(index) == 5 and all(r.error is None and r.keyframes[0]["size"] == 192 for r in index)
    broken = spark.createDataFrame([(1, bytearray(b"zz")), (2, None)], "k int, media binary")
    assert [r.error is not None for r in m.media_index(broken, "k", "media").collect()] == [True, True]
    assert m.text_media(df.limit(0), "doc_id", "text").count() == 0
