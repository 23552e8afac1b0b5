import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm import common, flac


def padded(text):
    data = (text or "").encode()
    return data + b" " * (-len(data) % 192 or (192 if not data else 0))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=9000), min_size=1, max_size=4))
def test_round_trip(payloads):
    streams = flac.encode(payloads)
    assert all(s[:4] == b"fLaC" for s in streams)
    for p, samples in zip(payloads, flac.decode(streams), strict=True):
        assert (samples.astype(np.int16) + 128).astype(np.uint8).tobytes() == p


def test_shapes_that_predict_well_and_badly():
    rng = np.random.default_rng(1)
    t = np.arange(30_000)
    shapes = [(128 + 100 * np.sin(t / 50)).astype(np.uint8), rng.integers(0, 256, 30_000).astype(np.uint8), np.full(30_000, 7, np.uint8), (t % 256).astype(np.uint8)]
    streams = flac.encode([s.tobytes() for s in shapes])
    for s, samples in zip(shapes, flac.decode(streams), strict=True):
        assert ((samples.astype(np.int16) + 128) == s).all()
    assert len(streams[0]) < 15_000 and len(streams[2]) < 5_000


def test_seek():
    data = bytes(np.random.default_rng(2).integers(60, 120, 50_000).astype(np.uint8))
    stream = flac.encode([data])[0]
    whole = np.frombuffer(data, np.uint8).astype(np.int16) - 128
    for at, n in ((0, 10), (4095, 3), (20_000, 9000), (49_990, 10)):
        assert (flac.read_at(stream, at, n) == whole[at : at + n]).all()


def test_damage_is_found():
    stream = bytearray(flac.encode([b"some bytes that are stored " * 40])[0])
    for at in (len(stream) - 1, len(stream) - 20):
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_digests(spark, tiny):
    docs = common.table(spark, tiny, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = flac.digests(docs).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len((texts[r.doc_id] or "").encode()), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    media = {r.doc_id: bytes(r.flac) for r in flac.stored(docs).collect()}
    assert all(hashlib.sha256(media[r.doc_id]).hexdigest() == r.media_sha256 and len(media[r.doc_id]) == r.media_bytes for r in rows)


def test_blocks(spark, odd, none):
    rows = flac.digests(odd).collect()
    assert len(rows) == odd.count() and {r.payload_bytes for r in rows if r.doc_id in (1, 2)} == {192}
    assert len({(r.media_sha256, r.feature) for r in rows if r.doc_id in (4, 5)}) == 1
    media = flac.stored(odd.where("doc_id = 6"))
    blocks = sorted(flac.pcm_blocks(media).collect(), key=lambda r: r.block)
    text = odd.where("doc_id = 6").first().text
    at = 0
    for b in blocks:
        assert b.sample == at
        at += len(b.pcm)
    assert at == len(padded(text)) and len(blocks) > 1
    assert flac.digests(none).count() == 0 and flac.stored(none).count() == 0


class Bits:
    """A stream put together bit by bit, by the format's description alone."""

    def __init__(self):
        self.bits = []

    def put(self, value, width):
        self.bits += [value >> i & 1 for i in range(width - 1, -1, -1)]

    def unary(self, n):
        self.bits += [0] * n + [1]

    def bytes(self):
        out = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, out[i : i + 8])), 2) for i in range(0, len(out), 8))


def crc(data, bits, poly):
    out = 0
    for byte in data:
        out ^= byte << (bits - 8)
        for _ in range(8):
            out = (out << 1 ^ poly if out >> (bits - 1) else out << 1) & ((1 << bits) - 1)
    return out


def partitions(b, residuals, order, size, kind, parts):
    """kind 0: parameters of 4 bits, 1: of 5; parts: a parameter each, or ("raw", bits)."""
    width, start = 4 + kind, 0
    b.put(kind, 2)
    b.put(len(parts).bit_length() - 1, 4)
    for i, k in enumerate(parts):
        own = residuals[start : start + size // len(parts) - (order if i == 0 else 0)]
        start += len(own)
        if isinstance(k, tuple):
            b.put((1 << width) - 1, width)
            b.put(k[1], 5)
            for r in own:
                b.put(r & ((1 << k[1]) - 1), k[1])
        else:
            b.put(k, width)
            for r in own:
                u = 2 * r if r >= 0 else -2 * r - 1
                b.unary(u >> k)
                b.put(u & ((1 << k) - 1), k)


def frame(number, x, subframe, variable=False, rate=4, depth=1):
    head = Bits()
    head.put(0xFFF9 if variable else 0xFFF8, 16)
    head.put(7, 4)
    head.put(rate, 4)
    head.put(0, 4)
    head.put(depth, 3)
    head.put(0, 1)
    coded = flac_number(number)
    data = head.bytes() + coded + (len(x) - 1).to_bytes(2, "big") + (b"\x08" if rate == 12 else b"")
    data += bytes([crc(data, 8, 0x07)])
    b = Bits()
    subframe(b, x)
    data += b.bytes()
    return data + crc(data, 16, 0x8005).to_bytes(2, "big")


def flac_number(n):
    return bytes([n]) if n < 0x80 else bytes([0xC0 | n >> 6, 0x80 | n & 0x3F]) if n < 0x800 else bytes([0xE0 | n >> 12, 0x80 | n >> 6 & 0x3F, 0x80 | n & 0x3F])


def fixed(order, kind, parts, wasted=0):
    def write(b, x):
        b.put(0, 1)
        b.put(8 | order, 6)
        b.put(int(wasted > 0), 1)
        if wasted:
            b.unary(wasted - 1)
        y = [v >> wasted for v in x]
        r = y
        for v in y[:order]:
            b.put(v & ((1 << (8 - wasted)) - 1), 8 - wasted)
        for _ in range(order):
            r = [q - p for p, q in zip(r, r[1:], strict=False)]
        partitions(b, r, order, len(x), kind, parts)

    return write


def linear(weights, shift, kind, parts, precision=15):
    def write(b, x):
        order = len(weights)
        b.put(0, 1)
        b.put(32 | (order - 1), 6)
        b.put(0, 1)
        for v in x[:order]:
            b.put(v & 0xFF, 8)
        b.put(precision - 1, 4)
        b.put(shift, 5)
        for w in weights:
            b.put(w & ((1 << precision) - 1), precision)
        guess = lambda t: sum(w * x[t - 1 - i] for i, w in enumerate(weights)) >> shift
        partitions(b, [x[t] - guess(t) for t in range(order, len(x))], order, len(x), kind, parts)

    return write


def constant(b, x):
    b.put(0, 8)
    b.put(x[0] & 0xFF, 8)


def verbatim(b, x):
    b.put(2, 8)
    for v in x:
        b.put(v & 0xFF, 8)


def described(frames, x, longest, md5=True, extra=b""):
    info = (16).to_bytes(2, "big") + longest.to_bytes(2, "big") + bytes(6) + (44100 << 44 | 7 << 36 | len(x)).to_bytes(8, "big")
    info += hashlib.md5(bytes(v & 0xFF for v in x)).digest() if md5 else bytes(16)
    return b"fLaC\x00" + (34).to_bytes(3, "big") + info + b"\x04" + (4).to_bytes(3, "big") + b"\0\0\0\0" + extra + b"\x81" + (0).to_bytes(3, "big") + b"".join(frames)


def test_streams_of_another_encoder():
    """No seek table; wasted bits, parameters of 5 bits, escaped partitions, an empty first one, order 12, blocks of many sizes, numbers of samples in headers."""
    rng = np.random.default_rng(7)
    wave = lambda n, phase: (90 * np.sin((np.arange(n) + phase) / 9) + rng.integers(-6, 7, n)).astype(int).tolist()
    weights = [9000, -2000, 500, 300, -100, 50, 25, -12, 6, -3, 2, 1]
    made = [
        (wave(64, 0), fixed(2, 0, [3, 4])), (wave(64, 64), fixed(1, 1, [2, 5, ("raw", 9), 4])), (wave(40, 128), linear(weights, 13, 0, [5])), (wave(48, 168), linear(weights[:4], 13, 1, [6, ("raw", 12)])),
        ([v & ~3 for v in wave(64, 200)], fixed(3, 0, [4, 4], wasted=2)), ([-5] * 17, constant), (wave(33, 300), verbatim), (wave(16, 333), fixed(4, 0, [5, 5, 5, 5])), ([0] * 32, fixed(0, 0, [("raw", 0)])), ([127, -128] * 8, fixed(0, 0, [0])),
    ]
    for variable, rate, depth in ((False, 4, 1), (True, 12, 0)):
        frames, x = [], []
        for k, (own, how) in enumerate(made):
            frames.append(frame(len(x) if variable else k, own, how, variable, rate, depth))
            x += own
        for md5 in (True, False):
            stream = described(frames, x, 64, md5)
            assert flac.decode([stream])[0].tolist() == x
            assert [(at, len(b)) for _, at, b in flac.blocks([stream])] == [(sum(len(m[0]) for m in made[:k]), len(own)) for k, (own, _) in enumerate(made)]
            assert flac.read_at(stream, 100, 50).tolist() == x[100:150]
        bad = bytearray(stream)
        bad[-5] ^= 1
        with pytest.raises(ValueError):
            flac.decode([bytes(bad)])


def test_long_streams_have_fewer_points(monkeypatch):
    monkeypatch.setattr(flac, "MOST_POINTS", 7)
    data = bytes(np.random.default_rng(2).integers(60, 120, 60_000).astype(np.uint8))
    stream = flac.encode([data])[0]
    assert len(flac.layout(stream).points) <= 7 and (flac.decode([stream])[0].astype(np.int16) + 128).astype(np.uint8).tobytes() == data
    assert (flac.read_at(stream, 30_000, 5_000).astype(np.int16) + 128).astype(np.uint8).tobytes() == data[30_000:35_000]


def test_memory_goes_by_frames_not_by_text():
    """Twice the text takes a few bytes more for each of its bytes, encoding and decoding."""
    import tracemalloc

    text = b"some words of a text that goes on and on. " * 70_000
    peaks = []
    for data in (text, text * 2):
        tracemalloc.start()
        stream = flac.encode([data])[0]
        encoded = tracemalloc.get_traced_memory()[1]
        tracemalloc.reset_peak()
        assert sum(len(x) for _, _, x in flac.blocks([stream])) == len(data)
        peaks.append((encoded, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
    assert all(b - a < 8 * len(text) for a, b in zip(*peaks, strict=True)), peaks


def test_null_streams(spark):
    media = spark.createDataFrame([(1, 0, None), (None, 3, flac.encode([b"abc"])[0])], "doc_id long, n_bytes long, flac binary")
    rows = {r.doc_id: r for r in flac.pcm(media).collect()}
    assert rows[1].blocks == [] and rows[1].media_bytes is None and bytes(rows[None].blocks[0].pcm) == bytes(b ^ 0x80 for b in b"abc")
    assert flac.pcm_blocks(media).count() == 1
