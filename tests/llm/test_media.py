"""Round trips through containers, damaged bytes, and sync tables."""

import hashlib
import struct
import zlib

from graphloom.llm import media

from .cases import documents


def test_round_trip():
    for n in (64, 4096, 4160, 20032):
        payload = bytes(k * 7 % 256 for k in range(n))
        data = media.audio_file(payload)
        (track,) = media.walk(data)
        assert b"".join(data[a:b] for a, b in track.byte_ranges(False)) == payload
        assert (track.codec, track.n_samples, track.total_ticks(), track.timescale) == ("raw ", n, n, media.RATE)


def test_keyframes_of_variable_samples():
    t = media.Track(sizes=[10, 20, 30, 40, 50], n_samples=5, chunk_offsets=[100, 500], runs=[(1, 3), (2, 2)], sync=[1, 4])
    assert t.byte_ranges() == [(100, 110), (500, 540)]
    assert t.byte_ranges(False) == [(100, 160), (500, 590)]


def test_damaged_bytes(spark):
    good = media.audio_file(bytes(64))
    rows = [(1, bytearray(good)), (2, None), (3, bytearray(b"not a container at all")), (4, bytearray(good[:200])), (5, bytearray(struct.pack(">I4s", 5, b"moov"))), (1, bytearray(good))]
    out = media.media_columns(spark.createDataFrame(rows, "file_id int, content binary"), "file_id", "content").orderBy("file_id").collect()
    assert [r["n_tracks"] for r in out][:2] == [1, 1] and out[0]["n_keyframes"] == 64
    assert [r["n_tracks"] for r in out][2:] == [0, 0, 0, 0]


def test_deep_boxes_and_empty_tables(spark):
    deep = b""
    for _ in range(4000):
        deep = media.box(b"moov", deep)
    shallow = media.audio_file(bytes(64))
    rows = [("a", bytearray(deep)), ("b", bytearray(deep + shallow)), (None, bytearray(b""))]
    files = spark.createDataFrame(rows, "file_id string, content binary").selectExpr("*", "'x' AS media_id", "1 AS n_tracks")
    out = {r["file_id"]: r["n_tracks"] for r in media.media_columns(files, "file_id", "content").collect()}
    assert out == {"a": 0, "b": 1, None: 0}
    assert media.media_columns(files.limit(0), "file_id", "content").count() == 0


def test_stored_texts(spark):
    docs = documents(spark, clashing=True)
    texts = {}
    for r in docs.collect():
        texts.setdefault(r["doc_id"], r["text"] or "")
    out = media.store_texts(docs).collect()
    assert len(out) == docs.count()
    for r in out:
        data = texts[r["doc_id"]].encode()
        padded = data + bytes(max(64, -(-len(data) // 64) * 64) - len(data))
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        assert hashlib.sha256(media.audio_file(padded)).hexdigest() == r["media_sha256"] and r["media_bytes"] == len(media.audio_file(padded))
    assert media.store_texts(documents(spark, rows=[])).count() == 0
