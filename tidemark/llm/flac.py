"""FLAC, 8 bits mono: streams of many texts' bytes encoded and decoded together, frame by frame abreast.

A frame is predicted by fixed or quantised linear predictors, residuals are Rice-coded, headers carry CRC-8 and frames CRC-16, and the seek table
names each frame's first sample and its place. So many frames of a batch's streams are encoded or decoded at once, sample by sample: numpy works on all of
them, and memory goes by their number, not by the length of a text. The decoder reads streams of other encoders too: where there's no
full seek table, frames are found by their headers' and their own checksums; constant and verbatim frames, wasted bits, any
predictor order, Rice partitions of both kinds and escaped ones are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import common

BLOCK, RATE, PAD, TAIL = 1152, 8000, 192, 16
LPC, PRECISION = 4, 12
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _table(bits: int, poly: int, of: int) -> np.ndarray:
    """CRCs of all numbers of `of` bits."""
    r = np.arange(1 << of, dtype=np.uint32) << (bits - of) if of <= bits else None
    for _ in range(of):
        r = np.where(r >> (bits - 1) & 1, (r << 1) ^ poly, r << 1) & ((1 << bits) - 1)
    return r


_CRC8, _CRC16, _CRC16_2 = _table(8, 0x07, 8), _table(16, 0x8005, 8), _table(16, 0x8005, 16)
_ZEROS = np.array([16] + [16 - int(i).bit_length() for i in range(1, 1 << 16)], np.int64)  # leading zeros of 16 bits


def crc8(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(starts), np.int64)
    for i in range(int(lengths.max(initial=0))):
        on = np.nonzero(lengths > i)[0]
        crc[on] = _CRC8[crc[on] ^ data[starts[on] + i]]
    return crc


def crc16(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC-16 of each stretch of data; two bytes of all stretches at a time."""
    order = np.argsort(-lengths, kind="stable")
    at, n = starts[order].copy(), lengths[order]
    pairs = n // 2
    two = np.append(data[:-1].astype(np.int64) << 8 | data[1:], 0) if len(data) else np.zeros(1, np.int64)
    crc = np.zeros(len(at), np.int64)
    active = np.searchsorted(-pairs, -np.arange(1, int(pairs.max(initial=0)) + 1), "right")
    for m in active:
        crc[:m] = _CRC16_2[crc[:m] ^ two[at[:m]]]
        at[:m] += 2
    odd = np.nonzero(n % 2)[0]
    crc[odd] = (crc[odd] << 8 & 0xFFFF) ^ _CRC16[crc[odd] >> 8 ^ data[at[odd]]]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number as UTF-8 would code it, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    size = next(k for k in range(2, 8) if n < 1 << (5 * k + 1))
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(size - 2, -1, -1)]
    return bytes([(0xFF00 >> size & 0xFF) | n >> 6 * (size - 1), *tail])


def _predictors(x: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients and shifts of order LPC for rows of samples of n numbers each (zeros after)."""
    f = x.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", f[:, k:], f[:, : f.shape[1] - k]) for k in range(LPC + 1)], 1)
    r[:, 0] = r[:, 0] * (1 + 1e-6) + 1e-6
    a, error = np.zeros((len(x), LPC)), r[:, 0].copy()
    for i in range(LPC):
        k = (r[:, i + 1] - (a[:, :i] * r[:, i:0:-1]).sum(1)) / error
        a[:, :i] -= k[:, None] * a[:, :i][:, ::-1].copy()
        a[:, i] = k
        error = np.maximum(error * (1 - k * k), 1e-9)
    top = np.maximum(np.abs(a).max(1), 1e-9)
    shift = np.clip(PRECISION - 2 - np.floor(np.log2(top)).astype(np.int64), 0, 14)
    most = (1 << (PRECISION - 1)) - 1
    return np.clip(np.round(a * 2.0 ** shift[:, None]), -most, most).astype(np.int64), shift


#: Frames of BLOCK samples that are worked on at once.
RUN = 1024
#: Parts of the input that digests() stores one after another.
PARTS = 4
#: Points that a seek table can hold.
MOST_POINTS = ((1 << 24) - 1) // 18


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream for each payload, its bytes being unsigned 8-bit samples."""
    if not payloads:
        return []
    lengths = np.array([len(p) for p in payloads])
    frames_of = -(-lengths // BLOCK)
    total = int(frames_of.sum())
    whole = np.frombuffer(payloads[0] if len(payloads) == 1 else b"".join(payloads), np.uint8)
    stream = np.repeat(np.arange(len(payloads)), frames_of)
    number = np.arange(total) - np.repeat(np.cumsum(frames_of) - frames_of, frames_of)
    n = np.minimum(BLOCK, lengths[stream] - number * BLOCK)
    first = (np.cumsum(lengths) - lengths)[stream] + number * BLOCK
    parts, sizes = [], np.zeros(total, np.int64)
    for a in range(0, total, RUN):
        run = slice(a, min(a + RUN, total))
        inside = np.arange(BLOCK) < n[run][:, None]
        x = np.zeros(inside.shape, np.int32)
        x[inside] = whole[first[a] : first[run.stop - 1] + n[run.stop - 1]].astype(np.int32) - 128
        made, sizes[run] = _encoded(x, n[run], number[run], inside)
        parts.append(made)
    packed, at = b"".join(parts), np.cumsum(sizes) - sizes
    begin, out, f = np.cumsum(lengths) - lengths, [], 0
    for s, count in enumerate(frames_of):
        own = slice(f, f + count)
        info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes[own].min()).to_bytes(3, "big") + int(sizes[own].max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | int(lengths[s])).to_bytes(8, "big")
        info += hashlib.md5((whole[begin[s] : begin[s] + lengths[s]] ^ 0x80).data).digest()
        step = max(1, -(-int(count) // MOST_POINTS))  # a very long stream has a point for every few frames
        points = np.zeros(-(-int(count) // step), np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")]))
        points["sample"], points["offset"], points["n"] = number[own][::step] * BLOCK, (at[own] - at[f])[::step], n[own][::step]
        seek = points.tobytes()
        out.append(b"".join((b"fLaC\x00", (34).to_bytes(3, "big"), info, b"\x83", len(seek).to_bytes(3, "big"), seek, packed[at[f] : at[f + count - 1] + sizes[f + count - 1]])))
        f += count
    return out


def _encoded(x: np.ndarray, n: np.ndarray, number: np.ndarray, inside: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Frames of rows of samples, one after another, and their sizes."""
    total = len(x)
    coefficients, shift = _predictors(x, n)
    tried, costs = [], []
    for order in range(3):
        r = np.diff(x, order, axis=1) if order else x
        tried.append((order, r))
    guess = np.zeros((total, BLOCK - LPC), np.int32)
    for i in range(LPC):
        guess += coefficients[:, i : i + 1].astype(np.int32) * x[:, LPC - 1 - i : BLOCK - 1 - i]
    tried.append((LPC, x[:, LPC:] - (guess >> shift[:, None].astype(np.int32))))
    for order, r in tried:
        cost = (np.abs(r) * inside[:, order:]).sum(1) + (0 if len(costs) < 3 else 60)
        costs.append(np.where(n > order, cost, 1 << 40))  # a frame has more samples than its predictor looks back
    best = np.argmin(np.stack(costs, 1), 1)
    order = np.array([0, 1, 2, LPC])[best]
    u = np.zeros((total, BLOCK), np.int32)
    for k, (o, r) in enumerate(tried):
        rows = best == k
        z = r[rows]
        u[rows, o:] = (z << 1) ^ (z >> 31)
    coded = inside & (np.arange(BLOCK) >= order[:, None])
    u[~coded] = 0
    m = coded.sum(1)
    bits = np.stack([(u >> k).sum(1) + m * (k + 1) for k in range(10)], 1)
    rice = bits.argmin(1)
    body = bits[np.arange(total), rice]
    heads = []
    for f in range(total):
        size = int(n[f])
        head = b"\xff\xf8" + bytes([(0x3 if size == 1152 else 0x7) << 4 | 0x4, 0x02]) + _number(int(number[f])) + (b"" if size == 1152 else struct.pack(">H", size - 1))
        crc = 0
        for c in head:
            crc = int(_CRC8[crc ^ c])
        heads.append(head + bytes([crc]))
    head_bytes = np.array([len(h) for h in heads])
    linear = best == 3
    before = 8 + order * 8 + np.where(linear, 9 + LPC * PRECISION, 0) + 10
    size = head_bytes + (before + body + 7) // 8 + 2
    at = np.cumsum(size) - size
    flat = np.zeros(int(size.sum()) * 8, np.uint8)
    start = (at + head_bytes) * 8

    def write(rows: np.ndarray, places: np.ndarray, values: np.ndarray, width: int) -> None:
        for b in range(width):
            flat[places + b] = values >> (width - 1 - b) & 1

    every = np.arange(total)
    write(every, start, np.where(linear, (0x20 | (order - 1)) << 1, (0x08 | order) << 1), 8)
    place = start + 8
    for i in range(LPC):
        rows = np.nonzero(order > i)[0]
        write(rows, place[rows] + 8 * i, x[rows, i] & 0xFF, 8)
    place = place + 8 * order
    rows = np.nonzero(linear)[0]
    write(rows, place[rows], (PRECISION - 1) << 5 | shift[rows], 9)
    for i in range(LPC):
        write(rows, place[rows] + 9 + i * PRECISION, coefficients[rows, i] & ((1 << PRECISION) - 1), PRECISION)
    place = place + np.where(linear, 9 + LPC * PRECISION, 0)
    write(every, place, rice, 10)  # method 0, one partition, its parameter
    q = u >> rice[:, None]
    length = np.where(coded, q + 1 + rice[:, None], 0)
    ends = (np.cumsum(length, axis=1) + (place + 10)[:, None])[coded]
    values, k = u[coded], np.repeat(rice, m)
    flat[ends - k - 1] = 1
    for b in range(int(rice.max(initial=0))):
        on = k > b if rice.min() <= b else slice(None)
        flat[ends[on] - 1 - b] = values[on] >> b & 1
    data = np.packbits(flat)
    head_at = np.repeat(at - (np.cumsum(head_bytes) - head_bytes), head_bytes) + np.arange(int(head_bytes.sum()))
    data[head_at] = np.frombuffer(b"".join(heads), np.uint8)
    crc = crc16(data, at, size - 2)
    data[at + size - 2], data[at + size - 1] = crc >> 8, crc & 0xFF
    return data.tobytes(), size


@dataclass
class Layout:
    """What a stream's metadata say: where frames begin, seek points (sample, offset, n), the samples' MD5 (zeros: unknown) and number (0: unknown), the longest block."""

    base: int
    points: np.ndarray
    md5: bytes
    samples: int
    longest: int


def layout(stream: bytes) -> Layout:
    if stream[:4] != b"fLaC":
        raise ValueError("not a FLAC stream")
    kind_of_point = np.dtype([("sample", ">u8"), ("offset", ">u8"), ("n", ">u2")])
    at, points, found, last = 4, np.zeros(0, kind_of_point), None, False
    while not last:
        last, kind, n = bool(stream[at] & 0x80), stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            numbers = int.from_bytes(stream[at + 14 : at + 22], "big")
            if numbers >> 41 & 7 or (numbers >> 36 & 31) != 7:
                raise ValueError("a stream of another kind than 8 bits, mono")
            found = (stream[at + 22 : at + 38], numbers & ((1 << 36) - 1), int.from_bytes(stream[at + 6 : at + 8], "big"))
        elif kind == 3:
            points = np.frombuffer(stream[at + 4 : at + 4 + n], kind_of_point)
            points = points[points["sample"] != (1 << 64) - 1]  # without placeholders
        at += 4 + n
    if found is None:
        raise ValueError("the stream has no description")
    return Layout(at, points, *found)


def _headers(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of frames that may start there: whether the header is one of 8 bits, mono, with the right CRC-8; samples; where the subframe begins."""
    data = np.append(data, np.zeros(24, np.uint8))
    lead = data[starts + 4].astype(np.int64)
    width = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    code, rate, at = (data[starts + 2] >> 4).astype(np.int64), data[starts + 2] & 0xF, starts + 4 + width
    n = np.select([code == 1, (code >= 2) & (code <= 5), code >= 8], [192, 576 << np.maximum(code - 2, 0), 256 << np.maximum(code - 8, 0)], 0)
    eight, sixteen = code == 6, code == 7
    n[eight] = data[at[eight]].astype(np.int64) + 1
    n[sixteen] = (data[at[sixteen]].astype(np.int64) << 8 | data[at[sixteen] + 1]) + 1
    at = at + eight + 2 * sixteen + np.select([rate == 12, (rate == 13) | (rate == 14)], [1, 2], 0)
    ok = (data[starts] == 0xFF) & ((data[starts + 1] & 0xFE) == 0xF8) & (code > 0) & (rate < 15) & np.isin(data[starts + 3], (0, 2))
    ok &= crc8(data, starts, at - starts) == data[at]
    return ok, n, at + 1


def _starts(stream: bytes, plan: Layout) -> np.ndarray:
    """Where the stream's frames start: by the seek table if it names each of them, else by the checksums."""
    data, points = np.frombuffer(stream, np.uint8)[plan.base :], plan.points
    ends = points["sample"].astype(np.int64) + points["n"]
    if len(points) and points["sample"][0] == 0 and (ends[:-1] == points["sample"][1:]).all() and ends[-1] == plan.samples:
        return points["offset"].astype(np.int64)
    if not len(data):
        return np.zeros(0, np.int64)
    found = np.nonzero((data[:-1] == 0xFF) & ((data[1:] & 0xFE) == 0xF8))[0]
    found = found[_headers(data, found)[0]]
    if not len(found) or found[0] != 0:
        raise ValueError("no frame header stands where the first frame should")
    whole = lambda a, b: b - a > 2 and int(crc16(data[a : b - 2], np.zeros(1, np.int64), np.array([b - 2 - a]))[0]) == (int(data[b - 2]) << 8 | int(data[b - 1]))
    out, a = [0], 0
    for b in (*found[1:].tolist(), len(data)):  # what looks like a header counts if the frame before it ends there
        if whole(a, b):
            out.append(b)
            a = b
    if a != len(data):
        raise ValueError("a frame's CRC-16 is wrong")
    return np.array(out[:-1], np.int64)


def blocks(streams: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(stream, first sample, signed 8-bit samples) for each frame of each stream, in order; raises ValueError where a checksum is wrong.

    So many frames as have RUN times BLOCK samples are decoded at once.
    """
    plans = [layout(s) for s in streams]
    starts = [_starts(s, p) for s, p in zip(streams, plans, strict=True)]
    run = max(1, RUN * BLOCK // max([BLOCK, *(p.longest for p in plans)]))
    every = [(k, a, b) for k, (s, p, own) in enumerate(zip(streams, plans, starts, strict=True)) for a, b in zip(own.tolist(), [*own[1:].tolist(), len(s) - p.base], strict=True)]
    digests, done = [hashlib.md5() for _ in streams], [0] * len(streams)
    for f in range(0, len(every), run):
        some = every[f : f + run]
        pieces = [streams[k][plans[k].base + a : plans[k].base + b] for k, a, b in some]
        sizes = np.array([len(p) for p in pieces])
        for (k, _, _), x in zip(some, _frames(np.frombuffer(b"".join(pieces), np.uint8), np.cumsum(sizes) - sizes), strict=True):
            digests[k].update(x.data)
            yield k, done[k], x
            done[k] += len(x)
    for p, digest, n in zip(plans, digests, done, strict=True):
        if (p.md5 != bytes(16) and digest.digest() != p.md5) or (p.samples and n != p.samples):
            raise ValueError("the samples' MD5 or number is wrong")


def decode(streams: list[bytes]) -> list[np.ndarray]:
    """The signed 8-bit samples of each stream; raises ValueError where a checksum is wrong."""
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.int8)] for _ in streams]
    for k, _, x in blocks(streams):
        parts[k].append(x)
    return [np.concatenate(p) for p in parts]


def read_at(stream: bytes, sample: int, n: int) -> np.ndarray:
    """n samples from the given one on, by the seek table: only the frames between the points about them are decoded."""
    plan = layout(stream)
    if not len(plan.points):
        return decode([stream])[0][sample : sample + n]
    first = plan.points["sample"].astype(np.int64)
    a = max(0, int(np.searchsorted(first, sample, "right")) - 1)
    b = max(a + 1, int(np.searchsorted(first, sample + n, "left")))
    offsets = np.append(plan.points["offset"].astype(np.int64), len(stream) - plan.base)
    body = stream[plan.base + offsets[a] : plan.base + offsets[b]]
    starts = _starts(body, Layout(0, plan.points[:0], b"", 0, plan.longest))
    return np.concatenate(_frames(np.frombuffer(body, np.uint8), starts))[sample - first[a] :][:n]


def _frames(data: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """The samples of the frames that start there and together fill data."""
    total = len(starts)
    if not total:
        return []
    ends = np.append(starts[1:], len(data))
    if (crc16(data, starts, ends - starts - 2) != (data[ends - 2].astype(np.int64) << 8 | data[ends - 1])).any():
        raise ValueError("a frame's CRC-16 is wrong")
    ok, n, at = _headers(data, starts)
    if not ok.all():
        raise ValueError("a frame header's CRC-8 is wrong, or the frame is of another kind than 8 bits, mono")
    padded = np.append(data, np.zeros(16, np.uint8)).astype(np.uint64)
    words = np.zeros(len(data) + 8, np.uint64)  # 64 bits from each byte on
    for i in range(8):
        words |= padded[i : i + len(words)] << np.uint64(56 - 8 * i)
    by_size = np.argsort(-n, kind="stable")
    n, pos = n[by_size], at[by_size] * 8

    def take(rows: np.ndarray, bits) -> np.ndarray:
        """The next so many bits (up to 32, one number for all or one each) of the rows."""
        p = pos[rows]
        w = words[p >> 3] << (p & 7).astype(np.uint64)
        bits = np.broadcast_to(bits, len(rows))
        pos[rows] = p + bits
        return np.where(bits > 0, w >> np.minimum(64 - bits, 63).astype(np.uint64), 0).astype(np.int64)

    def signed(v: np.ndarray, bits) -> np.ndarray:
        return v - ((v >> (bits - 1) & 1) << bits)

    every = np.arange(total)
    kind = take(every, 8)
    wasted = np.zeros(total, np.int64)
    for f in np.nonzero(kind & 1)[0]:  # low bits that are always 0 are named once, in unary
        wasted[f] = 1
        while not take(np.array([f]), 1)[0]:
            wasted[f] += 1
    kind, bits = kind >> 1, 8 - wasted
    if (bits < 1).any():
        raise ValueError("a frame wastes all its bits")
    fixed, linear, constant, verbatim = (kind & 0x38) == 8, kind >= 32, kind == 0, kind == 1
    order = np.where(linear, (kind & 31) + 1, np.where(fixed, kind & 7, 0))
    longest, deepest = int(n.max()), max(1, int(order.max()))
    x = np.zeros((longest + deepest, total), np.int32)  # sample t is row t + deepest
    for i in range(int(order.max())):
        rows = np.nonzero(order > i)[0]
        x[deepest + i, rows] = signed(take(rows, bits[rows]), bits[rows])
    weights, shift = np.zeros((deepest, total), np.int32), np.zeros(total, np.int32)
    for o in range(1, min(4, deepest) + 1):
        weights[:o, fixed & (order == o)] = np.array(_FIXED[o])[:, None]
    rows = np.nonzero(linear)[0]
    if len(rows):
        precision = take(rows, 4) + 1
        shift[rows] = take(rows, 5)
        for i in range(int(order[rows].max())):
            some = order[rows] > i
            weights[i, rows[some]] = signed(take(rows[some], precision[some]), precision[some])
    for rows, read in ((np.nonzero(constant)[0], 1), (np.nonzero(verbatim)[0], longest)):
        for t in range(read):
            rows = rows[n[rows] > t]
            if len(rows):
                x[deepest + t, rows] = signed(take(rows, bits[rows]), bits[rows])
    for f in np.nonzero(constant)[0]:
        x[deepest : deepest + n[f], f] = x[deepest, f]
    coded = fixed | linear
    rows = np.nonzero(coded)[0]
    if len(rows):
        _residuals(x, rows, n, pos, words, order, weights, shift, take, deepest)
    if wasted.any():
        x <<= wasted.astype(np.int32)
    out: list[np.ndarray] = [np.zeros(0, np.int8)] * total
    columns = np.ascontiguousarray(x[deepest:].T.astype(np.int8))
    for f, k in enumerate(by_size.tolist()):
        out[k] = columns[f, : n[f]]
    return out


def _residuals(x, rows, n, pos, words, order, weights, shift, take, deepest) -> None:
    """Reads the Rice codes of the rows and adds the predictions, one sample of all rows at a time."""
    method = take(rows, 2)
    if (method > 1).any():
        raise ValueError("residuals of a kind that isn't known")
    wide = 4 + method  # bits of a partition's parameter, all of them set: samples as they are, of as many bits as 5 more say
    part = n[rows] >> take(rows, 4)
    p, count, warm = pos[rows].astype(np.int64), n[rows], order[rows]
    w, s, v = weights[:, rows], shift[rows], np.zeros((x.shape[0], len(rows)), np.int32)
    v[:] = x[:, rows]
    k, raw = np.zeros(len(rows), np.int64), np.full(len(rows), -1, np.int64)
    depth = w.shape[0]
    back = w[::-1].copy()
    least, even = int(warm.min()), bool((part == count).all())
    u64, one = np.uint64, np.int64(1)

    def peek(q: np.ndarray, bits: np.ndarray) -> np.ndarray:
        return np.where(bits > 0, words[q >> 3] << (q & 7).astype(u64) >> np.minimum(64 - bits, 63).astype(u64), 0).astype(np.int64)

    active = np.searchsorted(-count, -np.arange(1, int(count.max()) + 1), "right")
    for t in range(least, int(count.max())):
        m = int(active[t])
        started = t >= int(warm.max())
        if not even or t <= int(warm.max()):
            new = np.nonzero((t == warm[:m]) | ((t > warm[:m]) & (t % part[:m] == 0)))[0]
            # a first partition that the predictor's own samples fill has a parameter and nothing else
            for some in (new[(t == warm[new]) & (part[new] == warm[new])], new):
                if len(some):
                    k[some] = peek(p[some], wide[some])
                    p[some] += wide[some]
                    escaped = some[k[some] == (1 << wide[some]) - 1]
                    raw[some] = -1
                    if len(escaped):
                        raw[escaped] = peek(p[escaped], np.full(len(escaped), 5))
                        p[escaped] += 5
                        k[escaped] = 0
        on = slice(0, m) if started else np.nonzero(warm[:m] <= t)[0]
        q = p[on].copy()
        window = words[q >> 3] << (q & 7).astype(u64)
        zeros = _ZEROS[window >> u64(48)]
        long = (zeros == 16) & (raw[on] < 0)
        if long.any():
            for i in np.nonzero(long)[0]:
                at, z = int(q[i]), 0
                while not int(words[at >> 3]) << (at & 7) >> 63 & 1:
                    at, z = at + 1, z + 1
                zeros[i] = z
            at = q + zeros
            window = words[at >> 3] << (at & 7).astype(u64)
            low = (window << u64(1) >> u64(1) >> (63 - k[on]).astype(u64)).astype(np.int64)
        else:
            low = (window << (zeros + 1).astype(u64) >> u64(1) >> (63 - k[on]).astype(u64)).astype(np.int64)
        u = zeros << k[on] | low
        p[on] = q + zeros + k[on] + one
        r = (u >> 1) ^ -(u & 1)
        if (plain := raw[on] >= 0).any():
            bits = raw[on][plain]
            r[plain] = peek(q[plain], bits)
            r[plain] -= (r[plain] >> np.maximum(bits - 1, 0) & 1) << bits
            p[np.arange(len(p))[on][plain]] = q[plain] + bits
        past = v[t : t + depth, on]
        v[t + depth, on] = r + (np.einsum("ij,ij->j", back[:, on], past) >> s[on])
    x[:, rows] = v


def payload(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and these with blanks up to a positive multiple of PAD."""
    data = text.encode()
    return len(data), data + b" " * (max(PAD, -(-len(data) // PAD) * PAD) - len(data))


def feature(parts: list[np.ndarray]) -> str:
    """Root mean square, mean step and sign changes about the mean, of signed samples that come in parts."""
    n, total, squares, steps, turns, last = 0, 0, 0, 0, 0, None
    for p in parts:
        x = p.astype(np.int64)
        n, total, squares = n + len(x), total + int(x.sum()), squares + int((x * x).sum())
        steps += int(np.abs(np.diff(x)).sum()) + (abs(int(x[0]) - last) if last is not None else 0)
        last = int(x[-1])
    side = None
    for p in parts:
        above = p.astype(np.int64) * n > total
        turns += int((above[1:] != above[:-1]).sum()) + (side is not None and bool(above[0]) != side)
        side = bool(above[-1])
    return f"rms={(squares / n) ** 0.5:.4f};step={steps / n:.4f};turns={turns / n:.4f}"


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, flac) for every document: its padded UTF-8 bytes as a FLAC stream, and how many there are without padding.

    Null text is the empty text, one padding unit; ids may be null or repeat; equal texts have equal streams. No documents: no rows. Further columns are left out.
    """
    common.shipped(docs.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches):
            sizes, payloads = zip(*map(payload, common.texts(b)), strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(encode(list(payloads)), pa.binary())], names=["doc_id", "n_bytes", "flac"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(made, "doc_id long, n_bytes long, flac binary")


_PCM = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, blocks array<struct<sample:bigint,pcm:binary>>"


def pcm(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media_bytes, media_sha256, blocks) for the streams of stored(): the decoded frames as PCM, each with its first sample's place, so that one finds any sample by it.

    All checksums are verified; a wrong one ends the job with ValueError. A null stream has no blocks, and null for what its bytes would say. Ids may be
    null or repeat. No streams: no rows.
    """
    common.shipped(media.sparkSession)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.slices(batches, "flac"):
            streams = b.column("flac").to_pylist()
            there = [k for k, s in enumerate(streams) if s is not None]
            counts, samples, data = np.zeros(len(streams) + 1, np.int32), [], []
            for k, at, x in blocks([streams[k] for k in there]):
                counts[there[k] + 1] += 1
                samples.append(at)
                data.append(x.tobytes())
            own = pa.StructArray.from_arrays([pa.array(samples, pa.int64()), pa.array(data, pa.binary())], names=["sample", "pcm"])
            sizes, sums = ([None if s is None else f(s) for s in streams] for f in (len, lambda s: hashlib.sha256(s).hexdigest()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(sizes, pa.int64()), pa.array(sums, pa.string()), pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), own)], names=["doc_id", "n_bytes", "media_bytes", "media_sha256", "blocks"])

    return media.mapInArrow(made, _PCM)


def pcm_blocks(media: DataFrame) -> DataFrame:
    """(doc_id, block, sample, pcm): a row for each block of pcm()."""
    return pcm(media).select("doc_id", F.posexplode("blocks").alias("block", "b")).select("doc_id", "block", "b.sample", "b.pcm")


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sizes, checksums and features of every document as stored and read back. Equal texts have equal values.

    Streams are written to the shared folder, read and decoded from there; so are the PCM blocks, which the digests are taken of. Both are larger than
    the compressed texts, so this is done in PARTS parts of the input's files, and what a part has stored is deleted once its digests are. Null text is
    the empty text; ids may be null or repeat; no documents: no rows. Further columns are left out.
    """
    spark, out = docs.sparkSession, []
    for part in common.dealt(docs, PARTS):
        paths = [common.new_path(spark, name) for name in ("media", "pcm")]
        media = common.written(stored(part, id_col, text_col), "media", path=paths[0])
        out.append(common.checkpointed(digests_of(common.written(pcm(media), "pcm", "zstd", paths[1]))))
        common.delete(spark, *paths)
    return reduce(DataFrame.unionAll, out)


def digests_of(decoded: DataFrame) -> DataFrame:
    """Digests of the rows of pcm()."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, 64) for x in batches for k in range(0, x.num_rows, 64)):
            rows = []
            for k in range(b.num_rows):
                parts = [np.frombuffer(x.as_buffer(), np.int8) for x in b.column("blocks")[k].values.field("pcm")]
                sha, tail, n = hashlib.sha256(), b"", 0
                for p in parts:
                    back = (p.view(np.uint8) ^ 0x80).tobytes()
                    sha.update(back)
                    tail, n = (tail + back)[-TAIL:], n + len(back)
                rows.append((n, sha.hexdigest(), zlib.crc32(tail), feature(parts)))
            n, sha, tail, text = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64()), pa.array(sha), pa.array(tail, pa.int64()), b.column("media_bytes"), b.column("media_sha256"), pa.array(text)], names=["doc_id", "n_bytes", *names])

    return decoded.mapInArrow(made, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
