import hashlib
import random
import zlib

import numpy as np
import pytest

from lantern.llm import flac, media

SCHEMA = "doc_id long, text string, media string, block int"


def payloads():
    r = random.Random(6)
    out = [bytes([7]) * 576, bytes(range(256)) * 9, b"".join(bytes([r.randrange(256)]) for _ in range(576 * 3)), media.payload("Some text. " * 500), media.payload("é日本語🙂 " * 90), media.payload(""), media.payload(None)]
    out.append(bytes(int(128 + 100 * np.sin(k / 20)) for k in range(576 * 40)))
    out.append(b"\x80" * 300 + b"\xff" + b"\x80" * 275)
    out.append(bytes((k * k // 50) % 256 for k in range(576 * 4)))
    return out


@pytest.mark.parametrize("lpc", [None, ([2, -1], 4, 0), ([30, -17, 3], 6, 4), ([5], 15, 3)])
def test_round_trip(lpc):
    got = flac.decode(flac.encode(payloads(), lpc))
    assert [x.tobytes() for x in got] == payloads()


def test_streams_do_not_depend_on_their_neighbours():
    assert flac.encode(payloads()) == [flac.encode([p])[0] for p in payloads()]


def test_every_kind_of_subframe_occurs_and_saves():
    streams = flac.encode(payloads())
    assert len(streams[0]) < 120 and len(streams[3]) < len(payloads()[3]) and len(streams[7]) < 0.6 * len(payloads()[7])


def test_seeking():
    p = payloads()[7]
    s = flac.encode([p])[0]
    for sample in (0, 1, 575, 576, 576 * 8, 576 * 17 + 5, len(p) - 1):
        at, got = flac.decode_from(s, sample, 2)
        assert at == sample // 576 * 576 and got.tobytes() == p[at : at + 1152]
    with pytest.raises(flac.FlacError):
        flac.decode_from(s, len(p))


def test_damage_is_noticed():
    s = flac.encode([payloads()[3]])[0]
    place = flac.seek_points(s)[1][0][1]
    for at in (place, place + 3, place + 4, place + 5, place + 60, len(s) - 1, 30):
        broken = bytearray(s)
        broken[at] ^= 0x10
        with pytest.raises((flac.FlacError, IndexError)):
            flac.decode([bytes(broken)])


def test_checksums_match_the_plain_definition():
    def crc16(raw):
        c = 0
        for b in raw:
            c ^= b << 8
            for _ in range(8):
                c = (c << 1 ^ 0x8005) & 0xFFFF if c & 0x8000 else c << 1 & 0xFFFF
        return c

    raw = np.frombuffer(b"\x00\x01fLaC frame\xff", np.uint8)
    starts, sizes = np.array([0, 2, 5]), np.array([13, 4, 1])
    assert flac._crc(raw, starts, sizes, 16).tolist() == [crc16(raw[a : a + n].tolist()) for a, n in zip(starts, sizes)]


def test_table(spark):
    texts = ["Hello " * 400, "", None, "x" * 576, "x" * 577, "é" * 288, "same", "same"]
    df = spark.createDataFrame([(i, t, "m", 1) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in media.digests(media.pcm(media.stored(df))).collect()}
    for i, t in enumerate(texts):
        p = media.payload(t)
        assert (got[i].n_bytes, got[i].payload_bytes) == (len((t or "").encode()), len(p))
        assert got[i].payload_sha256 == hashlib.sha256(p).hexdigest() and got[i].tail_crc32 == zlib.crc32(p[-32:])
    assert [len(media.payload(t)) for t in texts[1:6]] == [576, 576, 576, 1152, 576]
    assert got[6][1:] == got[7][1:]
    blocks = media.pcm_blocks(media.stored(df.where("doc_id = 0"))).orderBy("block").collect()
    assert b"".join(bytes(b.pcm) for b in blocks) == media.payload(texts[0]) and [b.sample_offset for b in blocks] == [576 * b.block for b in blocks]
    assert media.digests(media.pcm(media.stored(df.limit(0)))).count() == 0
