"""FLAC streams in columns: texts stored losslessly as 8-bit mono samples, and streams decoded into PCM blocks.

Decoding reads frame headers and subframes, decodes Rice-coded residuals, runs the linear predictors, verifies every
frame's CRC-8 and CRC-16 and the stream's MD5, and returns blocks with the offset of their first sample, so that a reader
can seek to any sample. Mono frames with one Rice partition (all that the encoder here writes) are decoded many at a
time: frames advance in step, one residual each, as numpy columns. Frames with several partitions, escapes, wasted bits
or two channels (also left/side, side/right, mid/side) take a bit reader; both give the same samples.

Encoding cuts the samples into blocks of BLOCK and gives each block the shortest of a constant, verbatim, a fixed
predictor (orders 0 to 2) or a linear predictor of order ORDER from its autocorrelation.

Defined results: a null or empty text is 64 zero bytes; repeated rows and equal texts give equal values; an empty table
gives no rows. A stream that breaks a checksum, is cut short or isn't FLAC is a ValueError, or in a table a row with the
error and no PCM.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from touchline.llm.common import slices, text_bytes

BLOCK, ORDER, PRECISION, RATE = 4096, 8, 10, 8000
PAD = 64
#: Rows of the CRC table; longer frames are summed byte by byte.
_REACH = BLOCK + 64

SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
PCM_SCHEMA = "id long, block int, sample_offset long, n_samples int, channels int, pcm binary, error string"


def _crc_table(bits: int, poly: int) -> np.ndarray:
    out = np.zeros(256, dtype=np.uint32)
    for b in range(256):
        c = b << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly if c >> (bits - 1) else c << 1) & ((1 << bits) - 1)
        out[b] = c
    return out


_CRC8 = [int(x) for x in _crc_table(8, 0x07)]
_CRC16 = _crc_table(16, 0x8005)


def _far_table() -> np.ndarray:
    """[j, b]: what byte b adds to the CRC-16 when j bytes follow it; the CRC is linear."""
    out = np.empty((_REACH, 256), dtype=np.uint16)
    c = _CRC16.copy()
    for j in range(_REACH):
        out[j] = c
        c = ((c << 8) & 0xFFFF) ^ _CRC16[c >> 8]
    return out


_FAR = _far_table()


def crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = _CRC8[c ^ b]
    return c


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of byte ranges that follow one another without overlap."""
    out = np.zeros(len(starts), dtype=np.int64)
    near = ends - starts <= _REACH
    for i in np.flatnonzero(~near):
        c = 0
        for b in data[starts[i] : ends[i]].tolist():
            c = ((c << 8) & 0xFFFF) ^ int(_CRC16[(c >> 8) ^ b])
        out[i] = c
    some = np.flatnonzero(near & (ends > starts))
    if len(some):
        n = ends[some] - starts[some]
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        at = np.arange(int(n.sum())) + np.repeat(starts[some] - first, n)
        out[some] = np.bitwise_xor.reduceat(_FAR[np.repeat(ends[some], n) - 1 - at, data[at]], first)
    return out


def coded_number(n: int) -> bytes:
    """A frame number in the format's variable-length code."""
    if n < 0x80:
        return bytes([n])
    tail = []
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        lead = 6 - len(tail)  # bits of the first byte
        if n < 1 << lead:
            return bytes([(0xFF << (lead + 1)) & 0xFF | n, *reversed(tail)])


def _levinson(r: np.ndarray, order: int) -> np.ndarray:
    """Predictor coefficients of many autocorrelations, [row, lag]."""
    a = np.zeros((len(r), order))
    error = r[:, 0] * (1 + 1e-9) + 1e-9
    for i in range(order):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(axis=1)) / error
        new = a.copy()
        new[:, i] = k
        new[:, :i] = a[:, :i] - k[:, None] * a[:, :i][:, ::-1]
        a, error = new, np.maximum(error * (1 - k * k), 1e-9)
    return a


def _zigzag(x: np.ndarray) -> np.ndarray:
    return (x << 1) ^ (x >> 31)


class _Bits:
    """A bit array that is written at positions."""

    def __init__(self, n: int):
        self.bits = np.zeros(n, dtype=np.uint8)

    def put(self, at: np.ndarray, values: np.ndarray, width: int) -> None:
        for b in range(width):
            self.bits[at + b] = (values >> (width - 1 - b)) & 1


def encode_blocks(samples: np.ndarray, first: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of 8-bit samples. first: each block's first sample (and the end); numbers: frame numbers in their streams."""
    x = samples.astype(np.int32)
    n = np.diff(first)
    block = np.repeat(np.arange(len(n)), n)
    inside = np.arange(len(x)) - first[:-1][block]
    lag = [x] + [np.concatenate([np.zeros(j, np.int32), x[:-j]])[: len(x)] for j in range(1, ORDER + 1)]
    fixed = [x, x - lag[1], x - 2 * lag[1] + lag[2]]
    sums = [np.add.reduceat(np.where(inside >= o, np.abs(f), 0), first[:-1]) for o, f in enumerate(fixed)]
    r = np.stack([np.add.reduceat(np.where(inside >= j, x * lag[j], 0), first[:-1], dtype=np.int64) for j in range(ORDER + 1)], axis=1).astype(float)
    coefficients = _levinson(r, ORDER)
    biggest = np.abs(coefficients).max(axis=1)
    shift = np.clip(PRECISION - 1 - np.ceil(np.log2(np.maximum(biggest, 1e-6) * (1 + 1e-9))), 0, 15).astype(np.int32)
    limit = (1 << (PRECISION - 1)) - 1
    q = np.clip(np.round(coefficients * (1 << shift)[:, None]), -limit, limit).astype(np.int32)
    guess = np.zeros(len(x), dtype=np.int32)
    for j in range(ORDER):
        guess += np.repeat(q[:, j], n) * lag[j + 1]
    linear = x - (guess >> np.repeat(shift, n))
    sums.append(np.add.reduceat(np.where(inside >= ORDER, np.abs(linear), 0), first[:-1]) + 12 * ORDER)
    kind = np.argmin(np.stack(sums), axis=0)
    kind[(kind == 3) & (n <= 4 * ORDER)] = 0
    order = np.array([0, 1, 2, ORDER])[kind]
    residual = np.choose(np.repeat(kind, n), [*fixed, linear])
    coded = inside >= np.repeat(order, n)
    u = np.where(coded, _zigzag(residual), 0)
    total = np.add.reduceat(u, first[:-1], dtype=np.int64)
    count = np.maximum(n - order, 1)
    rough = np.clip(np.floor(np.log2(np.maximum(total / count, 0.5) * 0.6931 + 0.5)), 0, 13).astype(np.int32)
    options = [np.clip(rough + d, 0, 14) for d in (0, 1)]
    cost = [np.add.reduceat(u >> np.repeat(k, n), first[:-1], dtype=np.int64) + (n - order) * (1 + k) for k in options]
    k = np.where(cost[0] <= cost[1], options[0], options[1])
    rice = np.minimum(*cost)
    head = 8 + 8 * order + np.where(kind == 3, 9 + PRECISION * ORDER, 0) + 10
    constant = np.maximum.reduceat(x, first[:-1]) == np.minimum.reduceat(x, first[:-1])
    verbatim = ~constant & (head + rice >= 8 + 8 * n)
    other = constant | verbatim
    size = np.where(constant, 16, np.where(verbatim, 8 + 8 * n, head + rice))
    headers = []
    for i in range(len(n)):
        plain = int(n[i]) == BLOCK
        h = bytes([0xFF, 0xF8, (0xC0 if plain else 0x70) | 0x04, 0x02]) + coded_number(int(numbers[i])) + (b"" if plain else struct.pack(">H", int(n[i]) - 1))
        headers.append(h + bytes([crc8(h)]))
    head_bytes = np.array([len(h) for h in headers])
    body = -(-size // 8)
    frame_at = np.concatenate([[0], np.cumsum(head_bytes + body + 2)])
    out = _Bits(int(frame_at[-1]) * 8)
    at = (frame_at[:-1] + head_bytes) * 8
    out.put(at, np.select([constant, verbatim, kind == 3], [0, 2, (32 + ORDER - 1) * 2], (8 + order) * 2), 8)
    lead = first[:-1]
    out.put(at[constant] + 8, x[lead[constant]] & 0xFF, 8)
    take = np.repeat(verbatim, n)
    out.put((np.repeat(at + 8, n) + 8 * inside)[take], x[take] & 0xFF, 8)
    pos = at + 8
    for o in range(ORDER):
        some = ~other & (order > o)
        out.put(pos[some] + 8 * o, x[np.minimum(lead[some] + o, len(x) - 1)] & 0xFF, 8)
    pos = pos + 8 * order
    some = ~other & (kind == 3)
    out.put(pos[some], np.full(int(some.sum()), PRECISION - 1), 4)
    out.put(pos[some] + 4, shift[some], 5)
    for j in range(ORDER):
        out.put(pos[some] + 9 + PRECISION * j, q[some, j], PRECISION)
    pos = pos + np.where(kind == 3, 9 + PRECISION * ORDER, 0)
    some = ~other
    out.put(pos[some] + 6, k[some], 4)  # method 0 and partition order 0 are zero bits
    take = coded & np.repeat(some, n)
    u, width, owner = u[take], np.repeat(k, n)[take], block[take]
    quotient = u >> width
    length = quotient + 1 + width
    ends = np.cumsum(length)
    start_of = np.searchsorted(owner, np.flatnonzero(some))
    base = np.concatenate([[0], ends])[start_of]
    where = ends - length - np.repeat(base, np.diff(np.append(start_of, len(owner)))) + np.repeat(pos[some] + 10, np.diff(np.append(start_of, len(owner))))
    out.bits[where + quotient] = 1
    for b in range(int(width.max()) if len(width) else 0):
        on = width > b
        out.bits[(where + length - 1 - b)[on]] = (u[on] >> b) & 1
    data = np.packbits(out.bits)
    for i, h in enumerate(headers):
        data[frame_at[i] : frame_at[i] + len(h)] = np.frombuffer(h, dtype=np.uint8)
    check = crc16(data, frame_at[:-1], frame_at[1:] - 2)
    data[frame_at[1:] - 2], data[frame_at[1:] - 1] = check >> 8, check & 0xFF
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(frame_at[:-1], frame_at[1:], strict=True)]


def _stream_head(n_samples: int, md5: bytes, sizes: list[int], rate: int = RATE) -> bytes:
    """Marker, STREAMINFO and a SEEKTABLE with a point a frame."""
    block = BLOCK if n_samples > BLOCK else max(16, n_samples)
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
    info += ((rate << 44) | (0 << 41) | (7 << 36) | n_samples).to_bytes(8, "big") + md5
    points, at = b"", 0
    for i, s in enumerate(sizes):
        points += struct.pack(">QQH", i * BLOCK, at, min(BLOCK, n_samples - i * BLOCK))
        at += s
    return b"fLaC" + bytes([0]) + len(info).to_bytes(3, "big") + info + bytes([0x83]) + len(points).to_bytes(3, "big") + points


def encode(payloads: list[bytes]) -> list[bytes]:
    """A stream for each payload (not empty) of unsigned bytes, taken as 8-bit samples less 128."""
    if not payloads:
        return []
    data = (np.frombuffer(b"".join(payloads), dtype=np.uint8) ^ 0x80).view(np.int8)
    counts = [-(-len(p) // BLOCK) for p in payloads]
    sizes = [min(BLOCK, len(p) - i * BLOCK) for p, c in zip(payloads, counts, strict=True) for i in range(c)]
    first = np.concatenate([[0], np.cumsum(sizes)])
    frames = encode_blocks(data, first, np.array([i for c in counts for i in range(c)]))
    out, f, s = [], 0, 0
    for p, c in zip(payloads, counts, strict=True):
        own = frames[f : f + c]
        out.append(_stream_head(len(p), hashlib.md5(data[s : s + len(p)].tobytes()).digest(), [len(x) for x in own]) + b"".join(own))
        f, s = f + c, s + len(p)
    return out


class _Reader:
    """Reads bits one field after another."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at, self.end = data, at * 8, len(data) * 8

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the stream is cut short")
        a, b = self.at // 8, (self.at + n + 7) // 8
        value = int.from_bytes(self.data[a:b], "big") >> (b * 8 - self.at - n)
        self.at += n
        return value & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        v = self.take(n)
        return v - (1 << n) if n and v >> (n - 1) else v

    def unary(self) -> int:
        n = 0
        while not self.take(1):
            n += 1
        return n


_FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))


def _subframe(bits: _Reader, n: int, width: int) -> np.ndarray:
    """One channel of a block, by the bit reader: any type, partitions, escapes, wasted bits."""
    if bits.take(1):
        raise ValueError("bad subframe")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
        width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * n
    elif kind == 1:
        out = [bits.signed(width) for _ in range(n)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind <= 12 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        shift, taps = 0, _FIXED[order] if kind <= 12 else ()
        if kind >= 32:
            precision = bits.take(4) + 1
            shift = bits.signed(5)
            taps = [bits.signed(precision) for _ in range(order)]
        wide, parts = 4 + bits.take(2), bits.take(4)
        if wide > 5 or n % (1 << parts):
            raise ValueError("bad residual")
        for p in range(1 << parts):
            count = (n >> parts) - (order if p == 0 else 0)
            k = bits.take(wide)
            raw = bits.take(5) if k == (1 << wide) - 1 else None
            for _ in range(count):
                if raw is not None:
                    e = bits.signed(raw) if raw else 0
                else:
                    u = (bits.unary() << k) | bits.take(k)
                    e = (u >> 1) ^ -(u & 1)
                out.append(e + (sum(c * out[-1 - j] for j, c in enumerate(taps)) >> shift))
    else:
        raise ValueError("reserved subframe type")
    return np.array(out, dtype=np.int64) << wasted


_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
_WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _frame_header(data: bytes, at: int, width: int) -> tuple[int, int, int, int]:
    """(block size, channel code, sample width, first byte of the subframes); checks the CRC-8."""
    if len(data) < at + 6 or data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one should begin")
    code, channels, bits = data[at + 2] >> 4, data[at + 3] >> 4, (data[at + 3] >> 1) & 7
    p = at + 4
    lead = data[p]
    p += 1 if lead < 0x80 else 8 - (lead ^ 0xFF).bit_length()
    if code in (6, 7):
        n = int.from_bytes(data[p : p + code - 5], "big") + 1
        p += code - 5
    else:
        n = _SIZES.get(code, 0)
    p += {12: 1, 13: 2, 14: 2}.get(data[at + 2] & 15, 0)
    if not n or channels > 10:
        raise ValueError("reserved frame header")
    if p >= len(data) or crc8(data[at:p]) != data[p]:
        raise ValueError("frame header checksum")
    return n, channels, _WIDTHS.get(bits, width), p + 1


def _slow_frame(data: bytes, at: int, width: int) -> tuple[np.ndarray, int]:
    """[sample, channel] of the frame at a byte, and the byte after it."""
    n, code, width, p = _frame_header(data, at, width)
    bits = _Reader(data, p)
    count = 2 if code > 7 else code + 1
    side = {8: 1, 9: 0, 10: 1}.get(code)
    a = [_subframe(bits, n, width + (c == side)) for c in range(count)]
    if code == 8:
        a[1] = a[0] - a[1]
    elif code == 9:
        a[0] = a[0] + a[1]
    elif code == 10:
        mid = (a[0] << 1) | (a[1] & 1)
        a = [(mid + a[1]) >> 1, (mid - a[1]) >> 1]
    end = (bits.at + 7) // 8
    whole = np.frombuffer(data, dtype=np.uint8)
    if end + 2 > len(data) or int(crc16(whole, np.array([at]), np.array([end]))[0]) != int.from_bytes(data[end : end + 2], "big"):
        raise ValueError("frame checksum")
    return np.stack(a, axis=1), end + 2


_CLZ = np.zeros(1 << 16, dtype=np.int64)
_CLZ[0] = 16
for _i in range(16):
    _CLZ[1 << _i : 2 << _i] = 15 - _i


def _fast_blocks(data: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """8-bit mono blocks whose subframe begins at byte at: samples, each block's first sample, byte after it, and whether it could be decoded so.

    Residuals are decoded in step: all blocks take their i-th code at once, then their i-th prediction.
    """
    padded = np.concatenate([data, np.zeros(16, dtype=np.uint8)]).astype(np.uint64)
    window = padded[:-8].copy()
    for j in range(1, 8):
        window = (window << np.uint64(8)) | padded[j : len(padded) - 8 + j]

    def take(pos: np.ndarray, width: int) -> np.ndarray:
        return ((window[pos >> 3] << (pos & 7).astype(np.uint64)) >> np.uint64(64 - width)).astype(np.int64)

    def signed(pos: np.ndarray, width: int) -> np.ndarray:
        v = take(pos, width)
        return np.where(v >> (width - 1), v - (1 << width), v)

    pos = at.astype(np.int64) * 8
    head = take(pos, 8)
    kind, good = head >> 1, (head & 0x81) == 0
    lpc = kind >= 32
    order = np.where(lpc, kind - 31, np.where(kind >= 8, kind - 8, 0))
    predicted = (lpc | ((kind >= 8) & (kind <= 12))) & (order < n)
    good &= (kind < 2) | predicted
    pos = pos + 8
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.zeros(int(first[-1]), dtype=np.int64)
    constant = good & (kind == 0)
    out[np.repeat(constant, n)] = np.repeat(signed(pos, 8)[constant], n[constant])
    plain = good & (kind == 1)
    some = np.repeat(plain, n)
    inside = np.arange(len(out)) - first[:-1].repeat(n)
    out[some] = data[np.minimum((np.repeat(at + 1, n) + inside)[some], len(data) - 1)].view(np.int8)
    end = np.where(constant, pos + 8, pos + 8 * n)
    rows = np.flatnonzero(good & predicted)
    if len(rows):
        rows = rows[np.argsort(-(n[rows] - order[rows]), kind="stable")]
        o, where = order[rows], pos[rows]
        most = int(o.max())
        taps = np.zeros((most, len(rows)), dtype=np.int64)
        for j in range(most):
            have = o > j
            out[first[rows[have]] + j] = signed(where[have] + 8 * j, 8)
        where = where + 8 * o
        shift = np.zeros(len(rows), dtype=np.int64)
        l = np.flatnonzero(lpc[rows])
        for f in range(5):
            for j, c in enumerate(_FIXED[f][:most]):
                taps[j, (o == f) & ~lpc[rows]] = c
        if len(l):
            precision = take(where[l], 4) + 1
            shift[l] = signed(where[l] + 4, 5)
            for j in range(most):
                for width in np.unique(precision):
                    own = l[(precision == width) & (o[l] > j)]
                    taps[j, own] = signed(where[own] + 9 + int(width) * j, int(width))
            where[l] += 9 + precision * o[l]
        form = take(where, 10)
        k = form & 15
        one = (form >> 4 == 0) & (k < 15) & (shift >= 0)
        good[rows[~one]] = False
        keep = np.flatnonzero(one)
        rows, o, where, k, shift, taps = rows[keep], o[keep], where[keep] + 10, k[keep], shift[keep], taps[:, keep]
        left = n[rows] - o
        limit = len(data) * 8
        grid = np.zeros((int(left[0]) + most if len(rows) else 0, len(rows)), dtype=np.int64)  # [residual + most, row]
        for j in range(most):  # the j-th sample before the first residual
            have = o > j
            grid[most - 1 - j, have] = out[first[rows[have]] + o[have] - 1 - j]
        ku = k.astype(np.uint64)
        back = np.uint64(64) - ku
        for i in range(int(left[0]) if len(rows) else 0):
            m = int(np.searchsorted(-left, -i, side="left"))
            w = where[:m]
            v = window[w >> 3] << (w & 7).astype(np.uint64)
            z = _CLZ[(v >> np.uint64(48)).astype(np.int64)]
            if z.max() == 16 or int(z.max()) + int(k[:m].max()) > 48:
                z = z.copy()
                far = np.flatnonzero(z == 16)
                while len(far):
                    p = np.minimum(w[far] + z[far], limit)
                    more = _CLZ[((window[p >> 3] << (p & 7).astype(np.uint64)) >> np.uint64(48)).astype(np.int64)]
                    z[far] += more
                    far = far[(more == 16) & (p < limit)]
                p = np.minimum(w + z + 1, limit)
                v = window[p >> 3] << (p & 7).astype(np.uint64)
            else:
                v = v << (z + 1).astype(np.uint64)
            u = (z << k[:m]) | np.where(k[:m] > 0, v >> np.minimum(back[:m], np.uint64(63)), np.uint64(0)).astype(np.int64)
            where[:m] = np.minimum(w + z + 1 + k[:m], limit)
            x = (u >> 1) ^ -(u & 1)
            if most:
                x = x + ((taps[:, :m] * grid[i : i + most, :m][::-1]).sum(axis=0) >> shift[:m])
            grid[i + most, :m] = x
        if len(rows):
            count = np.repeat(np.arange(len(rows)), left)
            step = np.arange(int(left.sum())) - np.concatenate([[0], np.cumsum(left)[:-1]]).repeat(left)
            out[first[rows][count] + o[count] + step] = grid[most + step, count]
            end[rows] = where
    return out, first, -(-end // 8), good


class Stream:
    """Sample rate, channels, sample width, number of samples, MD5 and seek points of a stream; and its frames' first byte."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        p, last, info = 4, False, None
        self.seek: list[tuple[int, int, int]] = []
        while not last:
            if p + 4 > len(data):
                raise ValueError("the stream is cut short")
            last, kind, n = bool(data[p] & 0x80), data[p] & 0x7F, int.from_bytes(data[p + 1 : p + 4], "big")
            body = data[p + 4 : p + 4 + n]
            if kind == 0:
                info = body
            elif kind == 3:
                self.seek = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, n - n % 18, 18)]
            p += 4 + n
        if info is None or len(info) < 34:
            raise ValueError("no stream information")
        packed = int.from_bytes(info[10:18], "big")
        self.rate, self.channels, self.width, self.samples = packed >> 44, ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1)
        self.md5, self.first = info[18:34], p


def decode(streams: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
    """For each stream its blocks as (offset of the first sample, [sample, channel]); all checksums are verified."""
    heads = [Stream(s) for s in streams]
    out: list[list] = [[] for _ in streams]
    fast = []
    for i, (s, h) in enumerate(zip(streams, heads, strict=True)):
        if h.channels == 1 and h.width == 8 and h.seek and sum(n for _, _, n in h.seek) == h.samples:
            fast.append(i)
        else:
            p, offset = h.first, 0
            while p < len(s) and (offset < h.samples or not h.samples):
                block, p = _slow_frame(s, p, h.width)
                out[i].append((offset, block))
                offset += len(block)
    if fast:
        # frames of all these streams, found by their seek points
        joined = np.frombuffer(b"".join(streams[i] for i in fast), dtype=np.uint8)
        base = np.concatenate([[0], np.cumsum([len(streams[i]) for i in fast])])
        at, n, begin, stop, owner = [], [], [], [], []
        for b, i in zip(base, fast, strict=False):
            points = heads[i].seek
            for j, (_, where, _) in enumerate(points):
                a = heads[i].first + where
                size, code, width, p = _frame_header(streams[i], a, 8)
                if code or width != 8:
                    raise ValueError("a seek point leads astray")
                at.append(b + p)
                n.append(size)
                begin.append(b + a)
                stop.append(b + (heads[i].first + points[j + 1][1] if j + 1 < len(points) else len(streams[i])))
                owner.append(i)
        begin, stop, n = np.array(begin), np.array(stop), np.array(n)
        samples, first, end, good = _fast_blocks(joined, np.array(at), n)
        ok = good & (end + 2 == stop)
        check = crc16(joined, begin, np.maximum(stop - 2, begin))
        ok &= check == (joined[stop - 2].astype(np.int64) << 8 | joined[stop - 1])
        for j, i in enumerate(owner):
            offset = out[i][-1][0] + len(out[i][-1][1]) if out[i] else 0
            if ok[j]:
                out[i].append((offset, samples[first[j] : first[j + 1], None]))
            else:
                out[i].append((offset, _slow_frame(streams[i], int(begin[j] - base[fast.index(i)]), 8)[0]))
    for blocks, h in zip(out, heads, strict=True):
        if h.samples and sum(len(b) for _, b in blocks) != h.samples:
            raise ValueError("the stream is cut short")
        if any(h.md5) and hashlib.md5(b"".join(pcm(b, h.width) for _, b in blocks)).digest() != h.md5:
            raise ValueError("stream checksum")
    return out


def pcm(block: np.ndarray, width: int) -> bytes:
    """Little-endian signed PCM, channels in turn."""
    n = -(-width // 8)
    return np.ascontiguousarray(block).astype("<i8").view(np.uint8).reshape(*block.shape, 8)[..., :n].tobytes()


def payload(text: bytes) -> bytes:
    """The text and zero bytes up to a positive multiple of PAD."""
    return text + bytes(-len(text) % PAD if text else PAD)


def features(blocks: list[tuple[int, np.ndarray]]) -> str:
    """Blocks, mean, root mean square and sign changes of the decoded samples."""
    x = np.concatenate([b for _, b in blocks])[:, 0]
    changes = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
    return f"blocks={len(blocks)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};crossings={changes}"


def media_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text stored as a stream, read back from the stored bytes, and described: SCHEMA."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes() for k in range(i, j)]
                streams = encode([payload(t) for t in texts])
                rows = []
                for text, stream, blocks in zip(texts, streams, decode(streams), strict=True):
                    back = b"".join((b[:, 0] + 128).astype(np.uint8).tobytes() for _, b in blocks)
                    rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(stream), hashlib.sha256(stream).hexdigest(), features(blocks)))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), *[pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in slices(offsets):
                streams = encode([payload(data[offsets[k] : offsets[k + 1]].tobytes()) for k in range(i, j)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(streams, pa.binary())], names=["id", "media"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id long, media binary")


def decode_media(streams: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """PCM blocks of every stream with the offset of their first sample: PCM_SCHEMA. A broken stream is one row with its error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    width = Stream(data or b"").width
                    rows = [(i, k, at, len(b), b.shape[1], pcm(b, width), None) for k, (at, b) in enumerate(decode([data])[0])]
                except ValueError as e:
                    rows = [(i, None, None, None, None, None, str(e))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds], names=[x.split()[0] for x in PCM_SCHEMA.split(", ")])

    return streams.select(id_col, media_col).mapInArrow(run, PCM_SCHEMA)
