"""Media columns: FLAC, written and read frame by frame in numpy.

Reading: Rice residuals (both parameter widths, partitions, escapes), constant, verbatim, fixed and linear
predictors, wasted bits, several channels and their differences are decoded; header CRC-8, frame CRC-16 and the stream's MD5 are verified. Frames are
decoded side by side: step t reads sample t of every frame at hand, so the work per sample is a few numpy
operations however the bits lie. Writing: blocks of 192 samples, mono, 8 bits, each by the cheapest of constant,
verbatim, fixed predictors of order 0 to 2 and a linear predictor of order 2; a seek table gives sample and byte
offsets. Decoded PCM is written in blocks that carry their first sample.

Only a bounded slice of frames is in memory besides the media value itself and its samples.

Defined results: a null text is an empty one; a text of any length is stored whole; repeated rows get equal results; an empty text is stored as 192 blanks; equal texts give equal
bytes; a damaged stream raises FlacError in decode() and gives a row with the message in pcm_blocks(); an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct

import numpy as np
from pyspark.sql import DataFrame

from .common import crc32, map_texts, only

BLOCK = 192
#: Frames from one seek point to the next, and how many points there are at most: a table has 18 bytes for each, 2^24 at most.
SEEK_EVERY = 4
MOST_SEEK = 900_000
RATE = 8000
PCM_BLOCK = 4608  # samples
_SLICE = 1 << 11  # frames that are written at once


class FlacError(ValueError):
    pass


def _crc_table(bits: int, poly: int) -> np.ndarray:
    """The remainders of all bytes for a CRC of `bits` bits, high bit first."""
    table = np.arange(256, dtype=np.uint32) << (bits - 8)
    for _ in range(8):
        table = np.where(table >> (bits - 1) & 1, (table << 1) ^ poly, table << 1) & ((1 << bits) - 1)
    return table


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crcs(data: np.ndarray, start: np.ndarray, length: np.ndarray, bits: int) -> np.ndarray:
    """CRCs of many byte ranges at once."""
    table = _CRC8 if bits == 8 else _CRC16
    crc = np.zeros(len(start), np.uint32)
    order = np.argsort(-length, kind="stable")
    at, n = start[order], length[order]
    alive = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1 if len(n) else 1), side="right")
    for t, k in enumerate(alive):
        byte = data[at[:k] + t]
        crc[:k] = byte_step(crc[:k], byte, table, bits)
    out = np.empty_like(crc)
    out[order] = crc
    return out


def byte_step(crc, byte, table, bits):
    if bits == 8:
        return table[crc ^ byte]
    return ((crc << 8) & 0xFFFF) ^ table[(crc >> 8) ^ byte]


def _coded_numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers (below 2^31) in FLAC's extended UTF-8: a row of 6 bytes each, and how many count."""
    n = n.astype(np.int64)
    size = 1 + (n >= 1 << 7) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    out = np.zeros((len(n), 6), np.uint8)
    for s in range(1, 7):
        rows = size == s
        v = n[rows]
        if s == 1:
            out[rows, 0] = v
            continue
        lead = (0xFF << (8 - s)) & 0xFF
        out[rows, 0] = lead | (v >> (6 * (s - 1)))
        for k in range(1, s):
            out[rows, k] = 0x80 | ((v >> (6 * (s - 1 - k))) & 0x3F)
    return out, size


def _zigzag(r: np.ndarray) -> np.ndarray:
    return np.where(r < 0, -2 * r - 1, 2 * r)


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The frames of blocks x (a row each, 8-bit samples): their bytes one after the other, and their sizes."""
    x = x.astype(np.int32)
    count = len(x)
    # linear prediction of order 2 from each block's autocorrelation, in steps of 1/64
    f = x.astype(np.float32)
    r0, r1, r2 = ((f[:, : BLOCK - k] * f[:, k:]).sum(1) for k in range(3))
    det = np.maximum(r0 * r0 - r1 * r1, 1e-3)
    c1 = np.clip(np.rint((r0 * r1 - r1 * r2) / det * 64), -127, 127).astype(np.int32)
    c2 = np.clip(np.rint((r0 * r2 - r1 * r1) / det * 64), -127, 127).astype(np.int32)
    residuals = {
        8: x,
        9: x[:, 1:] - x[:, :-1],
        10: x[:, 2:] - 2 * x[:, 1:-1] + x[:, :-2],
        33: x[:, 2:] - ((c1[:, None] * x[:, 1:-1] + c2[:, None] * x[:, :-2]) >> 6),
    }
    kinds = list(residuals)
    cost, param = [], []
    for kind in kinds:
        n = residuals[kind].shape[1]
        mean = _zigzag(residuals[kind]).sum(1) / n
        # the parameter that suits the mean, and about what the codes take with it
        k = np.clip(np.ceil(np.log2(np.maximum(mean, 1e-9) * 0.7)), 0, 9).astype(np.int64)
        param.append(k)
        cost.append(n * (k + 1) + n * np.maximum(mean - ((1 << k) - 1) / 2, 0) / (1 << k) + 8 * (BLOCK - n) + (35 if kind == 33 else 10))
    cost = np.stack(cost, 1)
    best = cost.argmin(1)
    least = cost[np.arange(count), best]
    constant = (x == x[:, :1]).all(1)
    verbatim = ~constant & (least >= 8 * BLOCK)
    kind = np.where(constant, 0, np.where(verbatim, 1, np.array(kinds)[best]))
    k = np.stack(param, 1)[np.arange(count), best]

    # the header: sync, 192 samples, 8 kHz, mono, 8 bits
    coded, coded_size = _coded_numbers(number)
    head = np.zeros((count, 11), np.uint8)
    head[:, :4] = (0xFF, 0xF8, 0x14, 0x02)
    head[:, 4:10] = coded
    head_size = 4 + coded_size
    flat = head.reshape(-1)
    begin = np.arange(count) * 11
    flat[begin + head_size] = _crcs(flat, begin, head_size, 8)

    # every frame's codes as (value, bits); a code with q zeros in front begins q bits later
    low = np.zeros((count, BLOCK), np.int32)
    width = np.zeros((count, BLOCK), np.int32)
    lengths = np.zeros((count, BLOCK), np.int32)
    raw = x & 0xFF
    for of, r in residuals.items():
        rows = np.flatnonzero(kind == of)
        warm = BLOCK - r.shape[1]
        u, p = _zigzag(r[rows]), k[rows, None].astype(np.int32)
        low[rows, warm:] = (1 << p) | (u & ((1 << p) - 1))
        width[rows, warm:] = p + 1
        lengths[rows, warm:] = (u >> p) + p + 1
        low[rows, :warm], width[rows, :warm], lengths[rows, :warm] = raw[rows, :warm], 8, 8
    low[verbatim], width[verbatim], lengths[verbatim] = raw[verbatim], 8, 8
    low[constant, 0], width[constant, 0], lengths[constant, 0] = raw[constant, 0], 8, 8
    warm = np.select([kind == 9, kind >= 10], [1, 2], 0)
    rice, lpc = kind >= 8, kind == 33
    # between warm-up and residual: for a linear predictor 4 bits of precision, 5 of shift and the coefficients
    # of 8 bits; then 2 bits of method, 4 of partition order and 4 of parameter
    everyone = np.arange(count)
    own = lengths[everyone, warm]
    lengths[everyone, warm] += np.where(rice, 10, 0) + np.where(lpc, 25, 0)
    ends = np.cumsum(lengths, 1, dtype=np.int64) + 8 * (head_size + 2)[:, None]
    size = (ends[:, -1] + 7) // 8 + 2
    offset = np.concatenate([[0], np.cumsum(size)])
    ends += offset[:-1, None] * 8
    here = width > 0
    mid = ends[everyone, warm] - own - np.where(rice, 10, 0) - np.where(lpc, 25, 0)
    at, value, bits = [(ends - width)[here]], [low[here]], [width[here]]
    for v, b, skip in ((np.full(count, 7), 4, 0), (np.full(count, 6), 5, 4), (c1 & 255, 8, 9), (c2 & 255, 8, 17)):
        at.append((mid + skip)[lpc]), value.append(v[lpc]), bits.append(np.full(lpc.sum(), b))
    at.append((mid + np.where(lpc, 25, 0) + 6)[rice]), value.append(k[rice]), bits.append(np.full(rice.sum(), 4))
    # codes have 10 bits at most and none overlap, so sums of what each adds to a byte are the bytes
    at, value, bits = np.concatenate(at), np.concatenate(value).astype(np.int64), np.concatenate(bits)
    both = value << (24 - (at & 7) - bits)
    byte, n = at >> 3, int(offset[-1]) + 3
    data = (np.bincount(byte, both >> 16, n) + np.bincount(byte + 1, both >> 8 & 255, n) + np.bincount(byte + 2, both & 255, n))[:-3].astype(np.uint8)
    for j in range(10):
        rows = j <= head_size
        data[offset[:-1][rows] + j] = head[rows, j]
    data[offset[:-1] + head_size + 1] = kind << 1
    crc = _crcs(data, offset[:-1], size - 2, 16)
    data[offset[1:] - 2], data[offset[1:] - 1] = crc >> 8, crc & 255
    return data, size


def encode_many(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose sizes are multiples of 192; a byte b is the sample b - 128."""
    frames = [len(p) // BLOCK for p in payloads]
    samples = (np.frombuffer(b"".join(payloads), np.uint8) ^ 128).view(np.int8).reshape(-1, BLOCK)
    number = np.concatenate([np.arange(n) for n in frames]) if frames else np.zeros(0, np.int64)
    parts, sizes = [], []
    for i in range(0, len(samples), _SLICE):
        data, size = _frames(samples[i : i + _SLICE], number[i : i + _SLICE])
        parts.append(data.tobytes())
        sizes.append(size)
    data, sizes = b"".join(parts), np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    out, byte, frame = [], 0, 0
    for payload, n in zip(payloads, frames, strict=True):
        own = sizes[frame : frame + n]
        total = int(own.sum())
        md5 = hashlib.md5(samples[frame : frame + n].tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + int(own.min()).to_bytes(3, "big") + int(own.max()).to_bytes(3, "big") + (RATE << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + md5
        every = SEEK_EVERY * max(1, -(-n // (SEEK_EVERY * MOST_SEEK)))
        starts = np.concatenate([[0], np.cumsum(own)[:-1]])[::every]
        seek = b"".join(struct.pack(">QQH", i * every * BLOCK, int(s), BLOCK) for i, s in enumerate(starts))
        out.append(b"fLaC" + b"\x00\x00\x00\x22" + info + b"\x83" + len(seek).to_bytes(3, "big") + seek + data[byte : byte + total])
        byte, frame = byte + total, frame + n
    return out


def metadata(media: bytes) -> dict:
    """STREAMINFO, the seek points and the offset of the first frame."""
    if media[:4] != b"fLaC":
        raise FlacError("no FLAC stream")
    at, last, found = 4, False, {"seek": []}
    while not last:
        if at + 4 > len(media):
            raise FlacError("metadata ends early")
        last, kind, size = media[at] >> 7, media[at] & 127, int.from_bytes(media[at + 1 : at + 4], "big")
        body = media[at + 4 : at + 4 + size]
        if len(body) < size:
            raise FlacError("metadata ends early")
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            found |= {"max_block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & ((1 << 36) - 1), "md5": body[18:34]}
        elif kind == 3:
            found["seek"] = [struct.unpack(">QQH", body[i : i + 18]) for i in range(0, size, 18)]
        at += 4 + size
    if "md5" not in found:
        raise FlacError("no STREAMINFO")
    return found | {"first_frame": at}


_BLOCK_SIZES = {1: 192} | {c: 576 << (c - 2) for c in range(2, 6)} | {c: 256 << (c - 8) for c in range(8, 16)}


class _Bits:
    """Big-endian bits of one buffer, read at many places at once."""

    def __init__(self, data: bytes):
        padded = np.frombuffer(data + bytes(16), np.uint8)
        self.size = len(data) * 8
        # the 32 bits from each byte on
        w = padded.astype(np.uint32)
        self.words = (w[:-3] << 24) | (w[1:-2] << 16) | (w[2:-1] << 8) | w[3:]
        self.bytes = padded

    def peek(self, at: np.ndarray, n) -> np.ndarray:
        """n bits, 24 at most."""
        got = self.words[np.minimum(at >> 3, len(self.words) - 1)].astype(np.int64)
        return (got >> (32 - (at & 7) - n)) & ((1 << n) - 1)

    def zeros(self, at: np.ndarray) -> np.ndarray:
        """How many zeros come before the next one."""
        total = np.zeros(len(at), np.int64)
        todo = np.arange(len(at))
        while len(todo):
            here = at[todo] + total[todo]
            if (here > self.size).any():
                raise FlacError("a residual runs past the end")
            v = self.peek(here, 24)
            run = np.where(v > 0, 23 - np.frexp(np.maximum(v, 1).astype(np.float64))[1] + 1, 24)
            total[todo] += run
            todo = todo[v == 0]
        return total


    def rice(self, at: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The codes with parameters k, and the positions after them."""
        v = (self.words[np.minimum(at >> 3, len(self.words) - 1)].astype(np.int64) << (at & 7)) & 0xFFFFFFFF
        q = _LEADING[v >> 16].astype(np.int64)
        used = q + k
        far = np.flatnonzero((used > 23) | (q == 16))  # not within the 25 bits at hand
        u = (q << k) | ((v >> np.maximum(31 - used, 0)) & ((1 << k) - 1))
        if len(far):
            q = self.zeros(at[far])
            u[far] = (q << k[far]) | self.peek(at[far] + q + 1, k[far])
            used[far] = q + k[far]
        return u, at + used + 1


#: Leading zeros of 16 bits.
_LEADING = (16 - np.frexp(np.arange(1 << 16).astype(np.float64))[1]).astype(np.uint8)


def _sign(v: np.ndarray, bits) -> np.ndarray:
    return v - ((v >> (bits - 1)) << bits)


def decode_many(streams: list[bytes]) -> list[np.ndarray]:
    """The samples of FLAC streams, with all checksums verified: a vector for one channel, else a column a channel.

    Frame k of every stream is decoded in round k: where a frame ends is known once it is decoded. Streams with
    a seek table start at all of their seek points at once.
    """
    infos = [metadata(s) for s in streams]
    out = [np.zeros((i["samples"], i["channels"]), np.int32) for i in infos]
    joined = b"".join(streams)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    bits = _Bits(joined)
    # chains of frames: (stream, byte, end byte, sample)
    of, at, stop, sample = [], [], [], []
    for i, info in enumerate(infos):
        points = [(p[0], p[1]) for p in info["seek"] if p[0] < info["samples"] or p[0] == 0] or [(0, 0)]
        first = base[i] + info["first_frame"]
        ends = [first + p[1] for p in points[1:]] + [base[i + 1]]
        for (s, b), e in zip(points, ends, strict=True):
            of.append(i), at.append(first + b), stop.append(e), sample.append(s)
    of, at, stop, sample = (np.array(v, np.int64) for v in (of, at, stop, sample))
    depth = np.array([i["bits"] for i in infos], np.int64)
    fixed_block = np.array([i["max_block"] for i in infos], np.int64)
    channels = np.array([i["channels"] for i in infos], np.int64)
    live = np.flatnonzero(at < stop)
    while len(live):
        values, blocks, ends = _decode_frames(bits, at[live], of[live], depth, sample[live], fixed_block, channels)
        for row, j in enumerate(live):
            s, n = sample[j], blocks[row]
            if s + n > len(out[of[j]]):
                raise FlacError("more samples than announced")
            out[of[j]][s : s + n] = values[: channels[of[j]], row, :n].T
        sample[live] += blocks
        at[live] = ends
        live = live[at[live] < stop[live]]
    if (at != stop).any():
        raise FlacError("a frame crosses a seek point")
    for o, info in zip(out, infos, strict=True):
        width = (info["bits"] + 7) // 8
        raw = np.ascontiguousarray(o.astype("<i4").reshape(-1, 1)).view(np.uint8)[:, :width].tobytes()
        if info["md5"] != bytes(16) and hashlib.md5(raw).digest() != info["md5"]:
            raise FlacError("MD5 differs")
    return [o[:, 0] if o.shape[1] == 1 else o for o in out]


def _subframes(bits: _Bits, pos: np.ndarray, block: np.ndarray, depth: np.ndarray):
    """One subframe from each bit position: samples (a row each), and the positions where they end."""
    sub = bits.peek(pos, 8)
    pos = pos + 8
    kind, wasted = sub >> 1 & 63, np.zeros(len(pos), np.int64)
    has = np.flatnonzero(sub & 1)
    if len(has):
        wasted[has] = bits.zeros(pos[has]) + 1
        pos[has] += wasted[has]
    depth = depth - wasted
    constant, verbatim, fixed, lpc = kind == 0, kind == 1, (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | lpc).all() or (depth > 24).any():
        raise FlacError("a reserved subframe")
    order = np.where(fixed, kind - 8, np.where(lpc, kind - 31, 0))
    if (order > block).any():
        raise FlacError("a predictor longer than its block")
    longest = int(block.max())
    x = np.zeros((len(pos), longest), np.int64)
    raw = np.where(verbatim, block, np.where(constant, 1, order))  # samples that stand as they are
    for t in range(int(raw.max())):
        r = np.flatnonzero(t < raw)
        x[r, t] = _sign(bits.peek(pos[r], depth[r]), depth[r])
        pos[r] += depth[r]
    x[constant] = x[constant, :1]
    # predictors: coefficients by distance, and a shift
    coefficients = np.zeros((len(pos), max(1, int(order.max()))), np.int64)
    shift = np.zeros(len(pos), np.int64)
    for o, c in ((1, (1,)), (2, (2, -1)), (3, (3, -3, 1)), (4, (4, -6, 4, -1))):
        coefficients[np.ix_(np.flatnonzero(fixed & (order == o)), np.arange(o))] = c
    r = np.flatnonzero(lpc)
    if len(r):
        precision = bits.peek(pos[r], 4) + 1
        shift[r] = _sign(bits.peek(pos[r] + 4, 5), 5)
        if (precision == 16).any() or (shift[r] < 0).any():
            raise FlacError("reserved predictor parameters")
        pos[r] += 9
        for j in range(int(order[r].max())):
            q = np.flatnonzero(j < order[r])
            coefficients[r[q], j] = _sign(bits.peek(pos[r[q]], precision[q]), precision[q])
            pos[r[q]] += precision[q]
    # residuals: a parameter at each partition's first sample
    rows = np.flatnonzero(fixed | lpc)
    if len(rows):
        method = bits.peek(pos[rows], 2)
        if (method > 1).any():
            raise FlacError("a reserved residual coding")
        partitions = bits.peek(pos[rows] + 2, 4)
        pos[rows] += 6
        per = block[rows] >> partitions
        wide = 4 + method
        param, escape = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
        n, o = block[rows], order[rows]
        if ((per << partitions) != n).any() or (per < o).any():
            raise FlacError("partitions don't fit the block")
        pad = max(1, int(o.max()))
        history = np.zeros((pad, len(rows)), np.int64)  # history[j]: the sample j + 1 steps back
        c = coefficients[rows, :pad].T.copy()
        escaped = False
        s = shift[rows]
        here = pos[rows]
        y = np.zeros((longest, len(rows)), np.int64)
        known = x[rows].T
        plain = int(o.max()) if (n == longest).all() else longest  # from here on every frame has residuals
        first = np.where(o > 0, o, 0)
        turns = set(np.unique(per).tolist())
        for t in range(longest):
            now = (t >= o) & (t < n) if t < plain or plain == longest else None
            # the parameter stands before a partition's first residual, which comes after the warm-up samples
            if t <= plain or any(t % p == 0 for p in turns):
                due = np.flatnonzero((t < n) & ((t == first) | (t > first) & (t % per == 0)))
            else:
                due = ()
            if len(due):
                if t:  # a first partition that holds warm-up samples only has a parameter too
                    e = due[(o[due] == t) & (per[due] == t)]
                    p = bits.peek(here[e], wide[e])
                    here[e] += wide[e] + np.where(p == (1 << wide[e]) - 1, 5, 0)
                w = wide[due]
                p = bits.peek(here[due], w)
                here[due] += w
                esc = p == (1 << w) - 1
                param[due], escape[due] = np.where(esc, 0, p), 0
                e = due[esc]
                if len(e):
                    escape[e] = bits.peek(here[e], 5) + 1  # bits + 1: a width of 0 is one too
                    here[e] += 5
                escaped = escape.any()
            if now is None and not escaped:
                u, here = bits.rice(here, param)
                v = (u >> 1) ^ -(u & 1)
                if pad == 1:
                    v += (history[0] * c[0]) >> s
                else:
                    v += (history * c).sum(0) >> s
            else:
                v = known[t].copy()
                now = np.ones(len(rows), bool) if now is None else now
                a = np.flatnonzero(now & (escape == 0))
                u, here[a] = bits.rice(here[a], param[a])
                v[a] = (u >> 1) ^ -(u & 1)
                b = np.flatnonzero(now & (escape > 0))
                if len(b):
                    w = escape[b] - 1
                    v[b] = np.where(w > 0, _sign(bits.peek(here[b], w), np.maximum(w, 1)), 0)
                    here[b] += w
                g = np.flatnonzero(now)
                v[g] += (history * c).sum(0)[g] >> s[g]
            y[t] = v
            for j in range(pad - 1, 0, -1):
                history[j] = history[j - 1]
            history[0] = v
        pos[rows] = here
        x[rows] = y.T
    x <<= wasted[:, None]
    return x, pos


def _decode_frames(bits: _Bits, start: np.ndarray, of: np.ndarray, depth: np.ndarray, sample: np.ndarray, fixed_block: np.ndarray, count: np.ndarray):
    """One frame from each start: samples (by channel, a row a frame), block sizes, and the bytes where the frames end."""
    head = bits.peek(start * 8, 16)
    if (head >> 1 != 0x7FFC).any():
        raise FlacError("no frame where one should begin")
    variable = head & 1
    codes = bits.peek(start * 8 + 16, 16)
    size_code, rate_code, channels, depth_code = codes >> 12, codes >> 8 & 15, codes >> 4 & 15, codes >> 1 & 7
    lead = bits.bytes[start + 4].astype(np.int64)
    coded = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [1, 2, 3, 4, 5, 6], 7)
    number = np.where(coded == 1, lead, lead & ((1 << np.maximum(7 - coded, 0)) - 1))
    for j in range(1, 7):
        number = np.where(j < coded, (number << 6) | (bits.bytes[np.minimum(start + 4 + j, len(bits.bytes) - 1)] & 0x3F), number)
    at = start + 4 + coded
    block = np.zeros(len(start), np.int64)
    for code, n in _BLOCK_SIZES.items():
        block[size_code == code] = n
    block = np.where(size_code == 6, bits.bytes[at].astype(np.int64) + 1, np.where(size_code == 7, bits.peek(at * 8, 16) + 1, block))
    at = at + np.select([size_code == 6, size_code == 7], [1, 2], 0) + np.select([rate_code == 12, (rate_code == 13) | (rate_code == 14)], [1, 2], 0)
    if not block.all():
        raise FlacError("a reserved block size")
    if (_crcs(bits.bytes, start, at - start, 8) != bits.bytes[at]).any():
        raise FlacError("a header's CRC-8 differs")
    if (np.where(variable, number, number * fixed_block[of]) != sample).any():
        raise FlacError("a frame is out of place")
    given = np.array([0, 8, 12, 0, 16, 20, 24, 32])[depth_code]
    depth = np.where(given > 0, given, depth[of])
    pos = (at + 1) * 8
    # one subframe a channel; a difference of both has a bit more
    stereo = channels >= 8
    own = np.where(stereo, 2, channels + 1)
    if (channels > 10).any() or (own != count[of]).any():
        raise FlacError("a frame's channels differ from the stream's")
    x = np.zeros((int(own.max()), len(start), int(block.max())), np.int64)
    for c in range(len(x)):
        rows = np.flatnonzero(c < own)
        difference = np.where(c == 0, channels[rows] == 9, (channels[rows] == 8) | (channels[rows] == 10)) & (c < 2)
        values, pos[rows] = _subframes(bits, pos[rows], block[rows], depth[rows] + difference)
        x[c, rows, : values.shape[1]] = values
    if stereo.any():
        a, b = x[0].copy(), x[1].copy()
        mode = channels[:, None]
        mid = (a << 1) | (b & 1)
        x[0] = np.select([mode == 9, mode == 10], [a + b, (mid + b) >> 1], a)
        x[1] = np.select([mode == 8, mode == 10], [a - b, (mid - b) >> 1], b)
    end = (pos + 7) >> 3
    if (end * 8 + 16 > bits.size).any():
        raise FlacError("a frame ends early")
    if (_crcs(bits.bytes, start, end - start, 16) != bits.peek(end * 8, 16)).any():
        raise FlacError("a frame's CRC-16 differs")
    return x, block, end + 2


def payload(text: str | None) -> bytes:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % BLOCK if raw else BLOCK)


def encoded(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` and `media`, each text's FLAC stream."""
    return map_texts(docs, keep, lambda texts: [encode_many([payload(x) for x in texts])], "media binary", most_chars=1 << 20)


def blocks_of(x: np.ndarray, bits: int, samples: int = PCM_BLOCK):
    """(first sample, number of samples, PCM) of a decoded stream's blocks: any of them is found by its first sample. PCM as WAV has it: signed, at 8 bits unsigned, channels side by side."""
    width = (bits + 7) // 8
    for at in range(0, max(1, len(x)), samples):
        part = x[at : at + samples]
        if width == 1:
            yield at, len(part), (part + (1 << (bits - 1))).astype(np.uint8).tobytes()
        else:
            yield at, len(part), np.ascontiguousarray(part.astype("<i4").reshape(-1, 1)).view(np.uint8)[:, :width].tobytes()


def pcm_blocks(media: DataFrame, keep: list[str], samples: int = PCM_BLOCK) -> DataFrame:
    """A row for each block of `samples` samples of each stream: keep, block, first_sample, n_samples, pcm, error.

    A damaged stream gives one row with an error and no pcm.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    source = media.select(*keep, "media")
    schema = StructType([source.schema[c] for c in keep] + list(StructType.fromDDL("block long, first_sample long, n_samples long, pcm binary, error string").fields))
    arrow = to_arrow_schema(schema)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i, stream in enumerate(batch.column(len(keep)).to_pylist()):
                try:
                    if stream is None:
                        raise FlacError("no stream")
                    made = [(b, *block, None) for b, block in enumerate(blocks_of(decode_many([stream])[0], metadata(stream)["bits"], samples))]
                except FlacError as e:
                    made = [(0, 0, 0, None, str(e))]
                own = [batch.column(c).take(pa.array([i] * len(made))).cast(arrow.field(c).type) for c in range(len(keep))]
                yield pa.RecordBatch.from_arrays(own + [pa.array(m, type=f.type) for m, f in zip(zip(*made, strict=True), list(arrow)[len(keep) :], strict=True)], schema=arrow)

    return source.mapInArrow(run, schema)


def feature(x: np.ndarray, media_bytes: int) -> str:
    """Samples, energy, changes of sign and peak, as whole numbers: the same for the same samples."""
    v = x.astype(np.int64)
    return f"n={len(v)};sum={int(v.sum())};energy={int((v * v).sum())};crossings={int(((v[1:] < 0) != (v[:-1] < 0)).sum())};min={int(v.min())};max={int(v.max())};permille={media_bytes * 1000 // len(v)}"


def digested(docs: DataFrame) -> DataFrame:
    """Of every document: its stored stream, read back into PCM blocks, as digests. pcm_blocks: their number; pcm_offsets: a CRC of their first samples."""

    def work(texts):
        payloads = [payload(x) for x in texts]
        media = encode_many(payloads)
        back = decode_many(media)
        blocks = [list(blocks_of(x, 8)) for x in back]
        raw = [b"".join(pcm for _, _, pcm in own) for own in blocks]
        return [
            [len((x or "").encode("utf-8", "surrogatepass")) for x in texts],
            [len(x) for x in raw],
            [hashlib.sha256(x).hexdigest() for x in raw],
            [crc32(x[-16:]) for x in raw],
            [len(x) for x in media],
            [hashlib.sha256(x).hexdigest() for x in media],
            [feature(x, len(m)) for x, m in zip(back, media, strict=True)],
            [len(own) for own in blocks],
            [crc32(np.array([at for at, _, _ in own], "<u8").tobytes()) for own in blocks],
        ]

    return map_texts(only(docs, "doc_id", "text"), ["doc_id"], work, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pcm_blocks long, pcm_offsets long", most_chars=1 << 21)
