"""FLAC media columns: encode bytes as 8-bit mono samples, decode to PCM blocks with seekable sample offsets.

A stream is ``fLaC``, STREAMINFO (with the MD5 of the samples), a SEEKTABLE with one point per frame, and frames of
``BLOCK`` samples. Each frame holds one subframe: constant, verbatim, or a linear predictor (the fixed ones of order 0 to
2, or given quantised coefficients) with Rice-coded residuals, whichever is shortest; CRC-8 closes the header and CRC-16
the frame.

The decoder reads mono streams of 8 to 24 bits with any fixed or quantised predictor, any Rice partition order and
escaped partitions. It works on many frames in step: sample t of all frames is decoded at once with numpy, so cost does
not depend on Python loops over samples. With a seek table all frames of a slice go in step, without one the
streams' current frames do. Checksums are verified before a block counts as whole; a broken frame gives a block with
``crc_ok`` false, and reading a payload with one raises ``ValueError``.

Defined results: null and empty texts make a payload of 64 zero bytes; equal texts make equal streams; an empty table gives
an empty table; extra columns pass through (an input column with an output's name is replaced).
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glosspark.llm.arrow import set_batches, text_udf
from glosspark.llm.rows import fresh

BLOCK = 1024
ALIGN = 64
RATE = 8000
SIZE_CODE = 10  # 256 << (code - 8) samples
BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))  # fixed values of the format


def _crc_table(poly: int, width: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, (out << 1) ^ poly, out << 1) & ((1 << width) - 1)
    return out


CRC8 = _crc_table(0x07, 8).astype(np.uint8)
CRC16 = _crc_table(0x8005, 16).astype(np.uint16)


@lru_cache(maxsize=2)
def _behind(most: int) -> np.ndarray:
    """Row d: a byte's part in the checksum when d bytes follow it."""
    rows = [CRC16]
    while len(rows) < most:
        rows.append((rows[-1] << 8) ^ CRC16[rows[-1] >> 8])
    return np.vstack(rows)


def crc16(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-16 of every range: the checksum is linear, so each byte's part is looked up and the parts are xored."""
    size = end - start
    table = _behind(-(-int(size.max(initial=1)) // 512) * 512).ravel()
    first = np.cumsum(size) - size
    at = np.arange(int(size.sum()))
    owner = np.repeat(np.arange(len(size)), size)
    where = at - first[owner]
    parts = table[(size[owner] - 1 - where) * 256 + data[start[owner] + where]]
    return np.bitwise_xor.reduceat(parts, first)


def crc8(header: bytes) -> int:
    crc = 0
    for byte in header:
        crc = int(CRC8[crc ^ byte])
    return crc


def coded_number(n: int) -> bytes:
    """A frame number in the format's UTF-8-like code."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x40
    while True:
        tail.append(0x80 | n & 0x3F)
        n >>= 6
        limit >>= 1
        if n < limit:
            return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *reversed(tail)])


def frame_header(number: int, samples: int) -> bytes:
    if samples == BLOCK:
        code, more = SIZE_CODE, b""
    elif samples <= 256:
        code, more = 6, bytes([samples - 1])
    else:
        code, more = 7, (samples - 1).to_bytes(2, "big")
    head = bytes([0xFF, 0xF8, code << 4, 0x02]) + coded_number(number) + more
    return head + bytes([crc8(head)])


def residuals(x: np.ndarray, head: np.ndarray, order: int, coefficients: tuple[int, ...], shift: int) -> np.ndarray:
    """What the predictor leaves of each sample; meaningless for the first ``order`` samples of a frame (``head`` marks frame starts)."""
    guess = np.zeros(len(x), np.int64)
    for j, c in enumerate(coefficients, 1):
        guess[j:] += c * x[:-j]
    return x - (guess >> shift)


def encode_streams(offsets: np.ndarray, payload: np.ndarray, lpc: tuple[tuple[int, ...], int] | None = None) -> list[bytes]:
    """One stream per row of 8-bit samples (rows must not be empty); ``lpc`` adds a quantised predictor (coefficients, shift <= 15)."""
    size = np.diff(offsets)
    frames = -(-size // BLOCK)
    row = np.repeat(np.arange(len(size)), frames)
    number = np.arange(len(row)) - np.repeat(np.cumsum(frames) - frames, frames)
    start = offsets[:-1][row] + number * BLOCK
    count = np.minimum(BLOCK, offsets[1:][row] - start)
    x = payload.astype(np.int64) - 128
    owner = np.repeat(np.arange(len(row)), count)
    place = np.arange(len(x)) - start[owner]
    shapes = [(f"fixed{o}", FIXED[o], 0) for o in range(3)] + ([("lpc", *lpc)] if lpc else [])
    best_bits = 8 * count  # verbatim
    kind = np.full(len(row), -1)
    rice = np.zeros(len(row), np.int64)
    folded = np.zeros(len(x), np.int64)
    for i, (_, coefficients, shift) in enumerate(shapes):
        order = len(coefficients)
        r = residuals(x, start, order, coefficients, shift)
        z = np.where(place < order, 0, (r << 1) ^ (r >> 63))
        total = np.add.reduceat(z, start)
        n = np.maximum(count - order, 1)
        guess = np.clip(np.log2(np.maximum(total / n * 0.69, 1)).astype(np.int64), 0, 13)
        side = order * 8 + 10 + (9 + order * 15 if i == 3 else 0)
        for k in (guess, guess + 1):
            bits = side + n * (1 + k) + np.add.reduceat(z >> k[owner], start)
            win = (bits < best_bits) & (count > order)
            best_bits, kind, rice = np.where(win, bits, best_bits), np.where(win, i, kind), np.where(win, k, rice)
        own = (kind == i)[owner]
        folded[own] = z[own]
    low, high = np.minimum.reduceat(x, start), np.maximum.reduceat(x, start)
    constant = low == high
    kind[constant] = -2
    best_bits[constant] = 8
    order = np.array([len(s[1]) for s in shapes] + [0, 0])[kind]
    heads = [frame_header(n, c) for n, c in zip(number.tolist(), count.tolist())]
    head = np.array(list(map(len, heads)))
    length = head + 1 + (best_bits + 7) // 8 + 2
    at = np.cumsum(length) - length
    bits = np.zeros(int(length.sum()) * 8, np.uint8)

    def put(where: np.ndarray, value: np.ndarray, width: int) -> None:
        for j in range(width):
            bits[where + j] = (value >> (width - 1 - j)) & 1

    body = (at + head) * 8
    put(body, np.array([(8 + len(s[1]) if s[0] != "lpc" else 31 + len(s[1])) << 1 for s in shapes] + [0, 2])[kind], 8)
    cursor = body + 8
    put(cursor[constant], x[start[constant]] & 255, 8)
    plain = np.flatnonzero((kind == -1)[owner])
    put(cursor[owner[plain]] + 8 * place[plain], x[plain] & 255, 8)
    coded = kind >= 0
    warm = np.flatnonzero(coded[owner] & (place < order[owner]))
    put(cursor[owner[warm]] + 8 * place[warm], x[warm] & 255, 8)
    cursor = cursor + 8 * order
    if lpc and (quantised := kind == 3).any():
        put(cursor[quantised], np.full(int(quantised.sum()), 14), 4)
        put(cursor[quantised] + 4, np.full(int(quantised.sum()), lpc[1]), 5)
        for j, c in enumerate(lpc[0]):
            put(cursor[quantised] + 9 + 15 * j, np.full(int(quantised.sum()), c & 0x7FFF), 15)
        cursor = cursor + quantised * (9 + 15 * order)
    put(cursor[coded], np.zeros(int(coded.sum()), np.int64), 6)  # Rice method 0, one partition
    put(cursor[coded] + 6, rice[coded], 4)
    cursor = cursor + 10
    own = np.flatnonzero(coded[owner] & (place >= order[owner]))
    k, z, mine = rice[owner[own]], folded[own], owner[own]
    width = (z >> k) + 1 + k
    to = np.cumsum(width)
    cut = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]])) if len(mine) else np.zeros(0, np.int64)
    base = np.repeat(to[cut] - width[cut], np.diff(np.append(cut, len(mine))))
    one = cursor[mine] + to - base - k - 1
    bits[one] = 1
    for j in range(int(k.max(initial=0))):
        live = k > j
        bits[one[live] + 1 + j] = (z[live] >> (k[live] - 1 - j)) & 1
    out = np.packbits(bits)
    for i, h in zip(at.tolist(), heads):
        out[i : i + len(h)] = np.frombuffer(h, np.uint8)
    crc = crc16(out, at, at + length - 2)
    out[at + length - 2], out[at + length - 1] = crc >> 8, crc & 255
    streams, raw, signed = [], out.tobytes(), (payload ^ 0x80).tobytes()
    cuts = np.concatenate([[0], np.cumsum(frames)])
    points = np.zeros((len(row), 18), np.uint8)
    points[:, 4:8] = (number * BLOCK).astype(">u4").view(np.uint8).reshape(-1, 4)
    points[:, 12:16] = (at - at[cuts[:-1]][row]).astype(">u4").view(np.uint8).reshape(-1, 4)
    points[:, 16:18] = count.astype(">u2").view(np.uint8).reshape(-1, 2)
    for i in range(len(size)):
        a, b = int(cuts[i]), int(cuts[i + 1])
        own_bytes = length[a:b]
        info = BLOCK.to_bytes(2, "big") * 2 + int(own_bytes.min()).to_bytes(3, "big") + int(own_bytes.max()).to_bytes(3, "big")
        info += ((RATE << 44) | (0 << 41) | (7 << 36) | int(size[i])).to_bytes(8, "big")
        info += hashlib.md5(signed[offsets[i] : offsets[i + 1]]).digest()
        seek = points[a:b].tobytes()
        end = int(at[b]) if b < len(at) else len(raw)
        streams.append(b"fLaC" + bytes([0, 0, 0, 34]) + info + bytes([0x83]) + len(seek).to_bytes(3, "big") + seek + raw[int(at[a]) : end])
    return streams


@dataclass
class Blocks:
    """Decoded blocks of some streams, in order; ``pcm[place[i]:place[i] + samples[i]]`` are block i's samples."""

    stream: np.ndarray
    first: np.ndarray
    samples: np.ndarray
    ok: np.ndarray
    place: np.ndarray
    pcm: np.ndarray


class Broken(ValueError):
    """A stream that is no mono FLAC."""


def open_stream(raw: bytes) -> tuple[int, int, bytes, list[tuple[int, int]]]:
    """Offset of the first frame, number of samples, MD5, and the seek table's (byte offset, first sample)."""
    if raw[:4] != b"fLaC" or len(raw) < 42:
        raise Broken("not a FLAC stream")
    at, last, total, digest, seek = 4, False, 0, b"", []
    while not last:
        kind, n = raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        last = raw[at] >= 128
        body = raw[at + 4 : at + 4 + n]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            if (packed >> 41) & 7:
                raise Broken("only one channel can be read")
            total, digest = packed & ((1 << 36) - 1), body[18:34]
        elif kind == 3:
            table = np.frombuffer(body, np.uint8).reshape(-1, 18)
            first, byte = (table[:, a : a + 8].copy().view(">u8").ravel().astype(np.uint64) for a in (0, 8))
            seek = [(int(b), int(f)) for b, f in zip(byte.tolist(), first.tolist()) if f < (1 << 63)]
        at += 4 + n
    return at, total, digest, seek


def read_header(raw: bytes, at: int) -> tuple[int, int, int, int]:
    """Bytes of a frame's header, its samples, bits a sample, and first sample or frame number (by the stream's code)."""
    if raw[at : at + 1] != b"\xff" or raw[at + 1] & 0xFE != 0xF8:
        raise Broken("no frame where one should start")
    code, rate, depth = raw[at + 2] >> 4, raw[at + 2] & 15, raw[at + 3] >> 1 & 7
    if raw[at + 3] >> 4:
        raise Broken("only one channel can be read")
    lead, p = raw[at + 4], at + 5
    more = 0 if lead < 0x80 else (lead ^ 0xFF).bit_length()
    more = 0 if lead < 0x80 else 8 - more - 1
    p += more
    samples = 192 if code == 1 else 576 << (code - 2) if 2 <= code < 6 else 256 << max(0, code - 8)
    if code in (6, 7):
        n = code - 5
        samples = int.from_bytes(raw[p : p + n], "big") + 1
        p += n
    p += (0, 1, 2, 2)[max(0, rate - 11)] if 12 <= rate <= 14 else 0
    if crc8(raw[at:p]) != raw[p]:
        raise Broken("a frame header's checksum is wrong")
    return p + 1 - at, samples, BITS[depth], 0


def decode_frames(data: np.ndarray, start: np.ndarray, heads: list[tuple[int, int, int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Decode frames in step: (place of each frame's samples, samples, end byte, checksum holds)."""
    n = len(start)
    head, count, depth = (np.array([h[k] for h in heads], np.int64) for k in range(3))
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.int64)
    padded = np.concatenate([data, np.zeros(16, np.uint8)]).astype(np.uint64)
    view = np.zeros(len(data) + 8, np.uint64)  # the eight bytes from each place on
    for j in range(8):
        view |= padded[j : len(data) + 8 + j] << np.uint64(56 - 8 * j)
    limit = 8 * (len(data) + 7)

    def take(pos: np.ndarray, width) -> np.ndarray:
        """Unsigned fields of 1 to 57 bits."""
        pos = np.minimum(pos, limit)
        word = view[pos >> 3] << (pos & 7).astype(np.uint64)
        return (word >> (np.uint64(64) - np.asarray(width, np.uint64))).astype(np.int64)

    def signed(v: np.ndarray, width) -> np.ndarray:
        top = np.int64(1) << (np.asarray(width, np.int64) - 1)
        return (v ^ top) - top

    pos = (start + head) * 8
    kind = take(pos, 8) >> 1
    if (take(pos, 8) & 1).any():
        raise Broken("wasted bits are not read")
    pos = pos + 8
    constant, verbatim = kind == 0, kind == 1
    fixed, quantised = (kind >= 8) & (kind <= 12), kind >= 32
    if not (constant | verbatim | fixed | quantised).all():
        raise Broken("unknown kind of subframe")
    order = np.where(fixed, kind - 8, np.where(quantised, kind - 31, 0))
    owner = np.repeat(np.arange(n), count)
    within = np.arange(len(out)) - place[owner]
    flat = constant[owner]
    out[flat] = signed(take(pos, depth), depth)[owner[flat]]
    plain = np.flatnonzero(verbatim[owner] | (within < order[owner]))
    o = owner[plain]
    out[plain] = signed(take(pos[o] + within[plain] * depth[o], depth[o]), depth[o])
    pos = pos + np.where(constant, depth, np.where(verbatim, depth * count, depth * order))
    most = int(order.max(initial=0))
    weights, shift = np.zeros((n, max(most, 1)), np.int64), np.zeros(n, np.int64)
    for k in np.flatnonzero(fixed & (order > 0)).tolist():
        weights[k, : order[k]] = FIXED[order[k]]
    if quantised.any():
        q = np.flatnonzero(quantised)
        precision = take(pos[q], 4) + 1
        shift[q] = signed(take(pos[q] + 4, 5), 5)
        pos[q] += 9
        for j in range(int(order[q].max())):
            live = order[q] > j
            weights[q[live], j] = signed(take(pos[q[live]], precision[live]), precision[live])
            pos[q[live]] += precision[live]
    coded = np.flatnonzero(fixed | quantised)
    if len(coded):
        wide = take(pos[coded], 2)
        if (wide > 1).any():
            raise Broken("unknown residual code")
        parts = take(pos[coded] + 2, 4)
        pos[coded] += 6
        field = 4 + wide
        p, left, k, raw_bits = pos[coded], np.zeros(len(coded), np.int64), np.zeros(len(coded), np.int64), np.full(len(coded), -1)
        done = order[coded].copy()
        part = np.zeros(len(coded), np.int64)
        size = count[coded]
        live = np.arange(len(coded))
        while len(live):
            fresh = live[left[live] == 0]
            while len(fresh):
                left[fresh] = (size[fresh] >> parts[fresh]) - np.where(part[fresh] == 0, order[coded[fresh]], 0)
                k[fresh] = take(p[fresh], field[fresh])
                p[fresh] += field[fresh]
                escaped = k[fresh] == (1 << field[fresh]) - 1
                raw_bits[fresh] = -1
                if escaped.any():
                    e = fresh[escaped]
                    raw_bits[e] = take(p[e], 5)
                    p[e] += 5
                part[fresh] += 1
                fresh = fresh[(left[fresh] == 0) & (done[fresh] < size[fresh])]
            run = int(left[live].min())  # samples until some frame comes to the end of its partition
            if run:
                rice = live[raw_bits[live] < 0]
                if len(rice):
                    at, kk, to = p[rice], k[rice], place[coded[rice]] + done[rice]
                    ku = kk.astype(np.uint64)
                    for t in range(run):
                        at = np.minimum(at, limit)
                        word = view[at >> 3] << (at & 7).astype(np.uint64)
                        top = word >> np.uint64(11)
                        zeros = 52 - ((top.astype(np.float64).view(np.int64) >> 52) - 1023)
                        if (odd := (zeros > 40)).any():  # a long run of zeros, or none but zeros in sight
                            zeros = zeros.copy()
                            for i in np.flatnonzero(odd).tolist():
                                q, b = 0, int(at[i])
                                while b < limit and not (int(data[b >> 3]) if b >> 3 < len(data) else 255) >> (7 - (b & 7)) & 1:
                                    q, b = q + 1, b + 1
                                zeros[i] = q
                            rest = at + zeros + 1
                            rest = np.minimum(rest, limit)
                            tail = view[rest >> 3] << (rest & 7).astype(np.uint64)
                        else:
                            tail = word << (zeros + 1).astype(np.uint64)
                        z = (zeros << kk) | ((tail >> np.uint64(1)) >> (np.uint64(63) - ku)).astype(np.int64)
                        out[to + t] = (z >> 1) ^ -(z & 1)
                        at = at + zeros + 1 + kk
                    p[rice] = at
                for i in live[raw_bits[live] >= 0].tolist():
                    b = int(raw_bits[i])
                    to = place[coded[i]] + done[i] + np.arange(run)
                    out[to] = signed(take(p[i] + b * np.arange(run), b), b) if b else 0
                    p[i] += b * run
                done[live] += run
                left[live] -= run
            live = live[done[live] < size[live]]
        pos[coded] = p
        for o in np.unique(order[coded]).tolist():
            own = coded[order[coded] == o] if o else coded[:0]
            by = own[np.argsort(-count[own], kind="stable")]
            w, s, base, cnt = weights[by], shift[by], place[by], -count[by]
            for t in range(o, int(-cnt[0]) if len(cnt) else 0):
                m = int(np.searchsorted(cnt, -t))
                to = base[:m] + t
                guess = np.zeros(m, np.int64)
                for j in range(o):
                    guess += w[:m, j] * out[to - 1 - j]
                out[to] += guess >> s[:m]
    end = (pos + 7) // 8
    whole = end + 2 <= len(data)
    ok = np.zeros(n, bool)
    if whole.any():
        crc = crc16(data, start[whole], end[whole])
        ok[whole] = (data[end[whole]].astype(np.int64) << 8 | data[end[whole] + 1]) == crc
    return place, out, end + 2, ok


def decode_streams(streams: list[bytes]) -> Blocks:
    """All blocks of the streams, by stream and sample offset. A frame that cannot be read ends its stream with a block that is not ok."""
    data = np.frombuffer(b"".join(streams), np.uint8)
    raw = data.tobytes()
    size = np.array(list(map(len, streams)), np.int64)
    base = np.cumsum(size) - size
    opened = [open_stream(s) for s in streams]
    todo = [(i, int(base[i]) + o[0] + b, f) for i, o in enumerate(opened) for b, f in o[3]]
    walk = {i: (int(base[i]) + o[0], 0) for i, o in enumerate(opened) if not o[3] and o[1]}
    found = []
    while todo or walk:
        batch = todo or [(i, a, f) for i, (a, f) in walk.items()]
        heads, kept = [], []
        for i, a, f in batch:
            try:
                heads.append(read_header(raw, a))
                kept.append((i, a, f))
            except (Broken, IndexError, KeyError):
                found.append((i, f, 0, False, np.zeros(0, np.int64)))
                walk.pop(i, None)
        if kept:
            place, pcm, end, ok = decode_frames(data, np.array([k[1] for k in kept], np.int64), heads)
            for j, ((i, _, f), h) in enumerate(zip(kept, heads)):
                found.append((i, f, h[1], bool(ok[j]), pcm[place[j] : place[j] + h[1]]))
                if not todo:
                    if ok[j] and f + h[1] < opened[i][1]:
                        walk[i] = (int(end[j]), f + h[1])
                    else:
                        walk.pop(i, None)
        todo = []
    found.sort(key=lambda x: (x[0], x[1]))
    samples = np.array([x[2] for x in found], np.int64)
    return Blocks(np.array([x[0] for x in found], np.int64), np.array([x[1] for x in found], np.int64), samples, np.array([x[3] for x in found], bool), np.cumsum(samples) - samples, np.concatenate([x[4] for x in found]) if found else np.zeros(0, np.int64))


def padded(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's bytes, zeros appended up to a positive multiple of ``ALIGN``."""
    size = np.diff(offsets)
    to = np.maximum(-(-size // ALIGN), 1) * ALIGN
    out_offsets = np.concatenate([[0], np.cumsum(to)])
    out = np.zeros(int(out_offsets[-1]), np.uint8)
    owner = np.repeat(np.arange(len(size)), size)
    out[np.arange(len(data)) + (out_offsets[:-1] - offsets[:-1])[owner]] = data
    return out_offsets, out


def encode_slice(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    return pa.array(encode_streams(*padded(offsets, data)), pa.binary())


READ = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, feature string"
PCM = "array<struct<block int, first_sample bigint, samples int, crc_ok boolean, pcm binary>>"


def _streams(offsets: np.ndarray, data: np.ndarray) -> list[bytes]:
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]


def read_slice(offsets: np.ndarray, data: np.ndarray) -> dict:
    """Payload digests and signal features from the stored bytes; raises if a frame or a stream's MD5 does not hold."""
    streams = _streams(offsets, data)
    blocks = decode_streams(streams)
    if not blocks.ok.all():
        raise Broken("a frame's checksum is wrong")
    cut = np.searchsorted(blocks.stream, np.arange(len(streams) + 1))
    edge = np.append(blocks.place, len(blocks.pcm))[cut]
    payload = (blocks.pcm + 128).astype(np.uint8)
    out: dict[str, list] = {"payload_bytes": [], "payload_sha256": [], "tail_crc32": [], "feature": []}
    for s, a, b in zip(streams, edge[:-1].tolist(), edge[1:].tolist()):
        own, x = payload[a:b], blocks.pcm[a:b]
        _, total, digest, _ = open_stream(s)
        if b - a != total or hashlib.md5((own ^ 0x80).tobytes()).digest() != digest:
            raise Broken("the samples do not match the stream's MD5")
        out["payload_bytes"].append(b - a)
        out["payload_sha256"].append(hashlib.sha256(own).hexdigest())
        out["tail_crc32"].append(zlib.crc32(own[-ALIGN:]))
        rms = (int(x @ x) / len(x)) ** 0.5
        crossings = int(((x[1:] < 0) != (x[:-1] < 0)).sum())
        out["feature"].append(f"rms={rms:.3f};mean={int(x.sum()) / len(x):.3f};peak={int(np.abs(x).max())};crossings={crossings}")
    return out


def block_slice(offsets: np.ndarray, data: np.ndarray) -> pa.Array:
    streams = _streams(offsets, data)
    blocks = decode_streams(streams)
    rows: list[list[dict]] = [[] for _ in streams]
    for s, f, n, ok, at in zip(blocks.stream.tolist(), blocks.first.tolist(), blocks.samples.tolist(), blocks.ok.tolist(), blocks.place.tolist()):
        rows[s].append({"block": len(rows[s]), "first_sample": f, "samples": n, "crc_ok": ok, "pcm": (blocks.pcm[at : at + n] + 128).astype(np.uint8).tobytes()})
    return pa.array(rows, pa.list_(pa.struct([("block", pa.int32()), ("first_sample", pa.int64()), ("samples", pa.int32()), ("crc_ok", pa.bool_()), ("pcm", pa.binary())])))


def with_media(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """``docs`` with the text's bytes stored as a FLAC stream."""
    set_batches(docs.sparkSession)
    return docs.withColumn(media, text_udf(encode_slice, "binary", 2 << 20)(F.col(text)))


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with payload_bytes, payload_sha256, tail_crc32 and feature, read back from the stored streams."""
    set_batches(df.sparkSession)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "feature"]
    own = fresh(df, "_m")
    out = df.withColumn(own, text_udf(read_slice, READ, 2 << 20)(F.col(media)))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in names), f"{own}.*")


def pcm_blocks(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per 8-bit block: the other columns, block, first_sample, samples, crc_ok and pcm; seek by filtering on first_sample."""
    set_batches(df.sparkSession)
    names = ["block", "first_sample", "samples", "crc_ok", "pcm"]
    own = fresh(df, "_b")
    out = df.withColumn(own, F.explode(text_udf(block_slice, PCM, 2 << 20)(F.col(media))))
    return out.select(*(F.col(f"`{c}`") for c in df.columns if c not in (media, *names)), f"{own}.*")


def media_report(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without texts: n_bytes, what ``read_media`` gives, media_bytes and media_sha256."""
    own = fresh(docs, "_stored")
    out = read_media(with_media(docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")), text, own), own)
    return out.withColumn("media_bytes", F.octet_length(own).cast("bigint")).withColumn("media_sha256", F.sha2(own, 256)).drop(own, text)
