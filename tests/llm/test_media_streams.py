"""FLAC streams that the encoder never writes, built here bit by bit, and stored texts read as PCM blocks."""

import hashlib
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import media


class Writer:
    def __init__(self):
        self.bits = []

    def put(self, value, n):
        self.bits += [(value >> (n - 1 - i)) & 1 for i in range(n)]

    def unary(self, n):
        self.bits += [0] * n + [1]

    def done(self):
        self.bits += [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, self.bits[i : i + 8])), 2) for i in range(0, len(self.bits), 8))


def crc(data, poly, bits):
    value = 0
    for byte in data:
        value ^= byte << (bits - 8)
        for _ in range(8):
            value = ((value << 1) ^ poly if value >> (bits - 1) else value << 1) & ((1 << bits) - 1)
    return value


def residual(w, x, order, parts):
    """parts: a Rice parameter, or (raw width,), of each partition."""
    w.put(0, 2), w.put(len(parts).bit_length() - 1, 4)
    size, at = (len(x) + order) // len(parts), 0
    for p, k in enumerate(parts):
        some = x[at : at + size - (order if p == 0 else 0)]
        at += len(some)
        if isinstance(k, tuple):
            w.put(15, 4), w.put(k[0], 5)
            for e in some:
                w.put(e & ((1 << k[0]) - 1), k[0])
        else:
            w.put(k, 4)
            for e in some:
                u = 2 * e if e >= 0 else -2 * e - 1
                w.unary(u >> k), w.put(u & ((1 << k) - 1), k)


def subframe(w, x, width, kind, parts=(3,), wasted=0, taps=(), shift=0):
    x = [v >> wasted for v in x]
    order = len(taps)
    w.put(0, 1), w.put({"constant": 0, "verbatim": 1, "fixed": 8 + order, "lpc": 31 + order}[kind], 6), w.put(wasted > 0, 1)
    if wasted:
        w.unary(wasted - 1)
    width -= wasted
    for v in x[: {"constant": 1, "verbatim": len(x)}.get(kind, order)]:
        w.put(v & ((1 << width) - 1), width)
    if kind in ("constant", "verbatim"):
        return
    if kind == "lpc":
        w.put(6, 4), w.put(shift, 5)
        for t in taps:
            w.put(t & 127, 7)
    residual(w, [x[i] - (sum(t * x[i - 1 - j] for j, t in enumerate(taps)) >> shift) for i in range(order, len(x))], order, parts)


def frame(number, n, channels, subframes):
    head = Writer()
    for value, bits in ((0xFFF8, 16), (6, 4), (9, 4), (channels, 4), (4, 3), (0, 1), (number, 8), (n - 1, 8)):
        head.put(value, bits)
    head = head.done()
    body = Writer()
    for arguments in subframes:
        subframe(body, **arguments)
    whole = head + bytes([crc(head, 0x07, 8)]) + body.done()
    return whole + struct.pack(">H", crc(whole, 0x8005, 16))


def stream(channels, samples, frames):
    raw = np.asarray(samples, dtype="<i2").tobytes()
    info = struct.pack(">HH", 16, 4096) + bytes(6) + ((44100 << 44) | (channels - 1) << 41 | 15 << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(raw).digest()
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)


def waves():
    t = np.arange(64)
    left = (900 * np.sin(t / 5) + 40 * np.cos(t * 1.7)).astype(int)
    return left.tolist(), (left + (30 * np.sin(t / 3)).astype(int)).tolist()


def streams():
    left, right = waves()
    side = [a - b for a, b in zip(left, right, strict=True)]
    mid = [(a + b) >> 1 for a, b in zip(left, right, strict=True)]
    both = list(zip(left, right, strict=True))
    even = [2 * (v // 2) for v in left]
    one = [[v] for v in left]
    square = {"x": left, "width": 16, "kind": "fixed", "taps": (2, -1), "parts": (5, (13,), 4, 6)}
    return {
        "partitions and an escape": (stream(1, one, [frame(0, 64, 0, [square])]), one),
        "wasted bits": (stream(1, [[v] for v in even], [frame(0, 64, 0, [{"x": even, "width": 16, "kind": "fixed", "taps": (1,), "parts": (6, 6), "wasted": 1}])]), [[v] for v in even]),
        "a linear predictor": (stream(1, one, [frame(0, 64, 0, [{"x": left, "width": 16, "kind": "lpc", "taps": (60, -31), "shift": 5, "parts": (6,)}])]), one),
        "independent stereo": (stream(2, both, [frame(0, 64, 1, [{"x": left, "width": 16, "kind": "verbatim"}, {"x": right, "width": 16, "kind": "fixed", "taps": (3, -3, 1), "parts": (7, 7)}])]), both),
        "left and side": (stream(2, both, [frame(0, 64, 8, [{"x": left, "width": 16, "kind": "fixed", "taps": (2, -1), "parts": (5,)}, {"x": side, "width": 17, "kind": "verbatim"}])]), both),
        "side and right": (stream(2, both, [frame(0, 64, 9, [{"x": side, "width": 17, "kind": "fixed", "taps": (1,), "parts": ((9,), (9,))}, {"x": right, "width": 16, "kind": "verbatim"}])]), both),
        "mid and side": (stream(2, both, [frame(0, 64, 10, [{"x": mid, "width": 16, "kind": "verbatim"}, {"x": side, "width": 17, "kind": "fixed", "taps": (2, -1), "parts": (4, 4)}])]), both),
        "two frames, one constant": (stream(1, one + [[-7]] * 64, [frame(0, 64, 0, [square]), frame(1, 64, 0, [{"x": [-7] * 64, "width": 16, "kind": "constant"}])]), one + [[-7]] * 64),
    }


def test_checksums_are_the_format_s():
    """The published check values of both polynomials."""
    text = b"123456789"
    assert media.crc8(text) == crc(text, 0x07, 8) == 0xF4
    assert media.crc16(np.frombuffer(text, dtype=np.uint8), np.array([0]), np.array([9])).tolist() == [crc(text, 0x8005, 16)] == [0xFEE8]


@pytest.mark.parametrize("name", sorted(streams()))
def test_foreign_streams_are_decoded(name):
    data, samples = streams()[name]
    blocks = media.decode([data])[0]
    assert [at for at, _ in blocks] == list(range(0, len(samples), 64))
    assert np.concatenate([b for _, b in blocks]).tolist() == [list(s) for s in samples]
    broken = bytearray(data)
    broken[-9] ^= 4
    with pytest.raises(ValueError):
        media.decode([bytes(broken)])


def test_stored_texts_are_read_as_pcm_blocks(spark, docs, rows):
    blocks = media.decode_media(media.store_texts(docs)).filter("id IS NOT NULL").collect()
    want = {i: media.payload((t or "").encode()) for i, t in rows if i is not None and i > 0}
    found = {}
    for r in sorted(blocks, key=lambda r: (r.id, r.block)):
        assert r.error is None and r.channels == 1 and len(r.pcm) == r.n_samples
        if r.id > 0:
            found[r.id] = found.get(r.id, b"") + (np.frombuffer(r.pcm, dtype=np.int8).astype(int) + 128).astype(np.uint8).tobytes()
            assert r.sample_offset == len(found[r.id]) - r.n_samples  # where a reader that seeks finds the block
    assert found == want
    odd = spark.createDataFrame([(1, bytearray(b"no stream")), (2, None), (3, bytearray(streams()["mid and side"][0]))], "id long, media binary")
    got = {r.id: r for r in media.decode_media(odd).collect()}
    assert got[1].error and got[2].error and got[3].error is None and got[3].channels == 2 and len(got[3].pcm) == 64 * 2 * 2
    assert media.decode_media(media.store_texts(docs.filter(F.lit(False)))).count() == 0
