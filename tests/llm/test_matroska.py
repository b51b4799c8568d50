import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomnote.llm import matroska as M

SCHEMA = "doc_id long, text string, media string, packets int"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=700), min_size=1, max_size=9), max_size=7), st.sampled_from([M.XIPH, M.EBML_LACING]), st.integers(1, 3))
def test_round_trip_of_lacings(blocks, lacing, per_cluster):
    data = M.write(blocks, lacing, 24, per_cluster=per_cluster)
    media = M.read(data)
    frames = [f for b in blocks for f in b]
    assert media.error is None and media.tracks[1]["codec"] == "A_PCM/INT/LIT" and media.tracks[1]["bits"] == 8
    assert [data[p.offset : p.offset + p.length] for p in media.packets] == frames
    assert [p.timestamp_ns for p in media.packets] == [i * 24_000_000 for i in range(len(frames))]
    assert [c.cluster for c in media.cues] == list(dict.fromkeys(p.cluster for p in media.packets))
    for c in media.cues:
        assert int.from_bytes(data[c.cluster : c.cluster + 4], "big") == M.CLUSTER
        _, start, _ = M.element(data, c.cluster, len(data))
        assert data[start + c.relative] == M.SIMPLE_BLOCK


@settings(max_examples=300, deadline=None)
@given(st.binary(max_size=300), st.integers(0, 400), st.integers(0, 255))
def test_damage_never_crashes(payload, at, byte):
    assert M.read(payload).error is not None or not M.read(payload).packets
    data = bytearray(M.write([[payload, b"x" * 50]] * 2, M.EBML_LACING, 24))
    data[at % len(data)] = byte
    M.read(bytes(data))
    cut = M.read(bytes(data[: at % len(data)]))
    assert all(p.offset + p.length <= len(data) for p in cut.packets)


def test_hand_made_file():
    """A file from bytes by hand: a cluster of unknown size, a block group, an unlaced block and two tracks."""
    group = M._element(M.BLOCK_GROUP, M._element(M.BLOCK, bytes([0x82, 0xFF, 0xFE, 0x00]) + b"abc") + M._element(M.REFERENCE_BLOCK, b"\x01"))
    simple = M._element(M.SIMPLE_BLOCK, bytes([0x81, 0x00, 0x05, 0x80]) + b"hello")
    cluster = M.CLUSTER.to_bytes(4, "big") + b"\xff" + M._uint(M.TIMESTAMP, 100) + group + simple
    info = M._element(M.INFO, M._uint(M.TIMESTAMP_SCALE, 500))
    data = M._element(M.EBML, b"") + M.SEGMENT.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + info + cluster + M._element(M.CUES, b"")
    media = M.read(data)
    assert media.error is None
    got = [(p.track, p.timestamp_ns, data[p.offset : p.offset + p.length], p.keyframe, p.lacing) for p in media.packets]
    assert got == [(2, 98 * 500, b"abc", False, "none"), (1, 105 * 500, b"hello", True, "none")]


def test_vint():
    assert M.vint(b"\x81", 0, 1) == (0x81, 1, 1)
    assert M.vint(b"\x40\x7f", 0, 2) == (0x407F, 0x7F, 2)
    assert M.vint(b"\x1a\x45\xdf\xa3", 0, 4)[0] == M.EBML
    for bad in (b"", b"\x00", b"\x40"):
        with pytest.raises(M.Malformed):
            M.vint(bad, 0, len(bad))


def test_text_media(spark):
    texts = [None, "", "a", "x" * 192, "é" * 96, "é" * 97, "long text " * 40000, "a", "\x00\n 数"]
    df = spark.createDataFrame([(i if i else None, t, "clash", 3) for i, t in enumerate(texts)], SCHEMA)
    rows = M.text_media(df, keep_media=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        raw = (texts[r.doc_id or 0] or "").encode()
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest())
        assert r.tail_crc32 == zlib.crc32(padded[-16:])
        assert (r.media_bytes, r.media_sha256) == (len(r.media), hashlib.sha256(r.media).hexdigest())
        assert M.stored_bytes(bytes(r.media)) == padded
        assert r.packets == len(padded) // 192
    assert len({(texts[r.doc_id or 0] or "", r.media_sha256, r.feature) for r in rows}) == len({t or "" for t in texts})
    assert M.text_media(df.limit(0)).count() == 0

    media = spark.createDataFrame([(r.doc_id, r.media) for r in rows] + [(98, b"junk"), (99, None)], "doc_id long, media binary")
    packets = M.packet_table(media).collect()
    assert len(packets) == sum(r.packets for r in rows)
    assert all(p.cued and p.lacing == "fixed" and p.length == 192 and p.timestamp_ns == p.packet * 24_000_000 for p in packets)
    assert {r.doc_id for r in M.faults(media).collect()} == {98, 99}
    cues = M.cue_table(media).collect()
    assert len(cues) == len({(p.doc_id, p.cluster) for p in packets})


def test_features_tell_signals_apart():
    rng = random.Random(1)
    assert M.features(bytes(192), 1) != M.features(bytes(rng.randrange(256) for _ in range(192)), 1)
    assert M.features(b"", 0) == "packets=0"
