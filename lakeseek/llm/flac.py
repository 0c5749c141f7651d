"""FLAC media columns: encoder, decoder and block reader, vectorised over frames.

A stream has a seek point for every frame, so its frames decode side by side: each lane holds one frame, each step decodes one
sample of every lane (unary part by the exponent of a float, then the remainder bits), linear predictors run along the same
steps. Header CRC-8, frame CRC-16 and the stream's MD5 are all verified; a stream whose seek points are sparser decodes too, its
lanes going from frame to frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK, UNIT, RATE = 576, 192, 8000
#: Payload bytes that are encoded or decoded at once.
CHUNK = 2_500_000
U = np.uint64


def _crc_table(poly: int, bits: int) -> np.ndarray:
    top, mask, out = 1 << (bits - 1), (1 << bits) - 1, []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = ((c << 1) ^ poly) & mask if c & top else (c << 1) & mask
        out.append(c)
    return np.array(out, np.uint16 if bits == 16 else np.uint8)


_CRC8, _CRC16 = _crc_table(0x07, 8), _crc_table(0x8005, 16)


def _crc8(data: bytes) -> int:
    c = 0
    for b in data:
        c = int(_CRC8[c ^ b])
    return c


def crc16(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of each buffer[start:end]. Zeros in front don't change it, so all lanes end together."""
    order = np.argsort(starts - ends, kind="stable")
    starts, ends, width = starts[order], ends[order], ends - starts
    lengths = width[order]
    crc, n = np.zeros(len(starts), np.uint16), len(starts)
    for back in range(int(lengths[0]) if n else 0, 0, -1):
        live = int(np.searchsorted(-lengths, -back, "right"))
        c = crc[:live]
        crc[:live] = (c << np.uint16(8)) ^ _CRC16[(c >> np.uint16(8)).astype(np.uint8) ^ buffer[ends[:live] - back]]
    out = np.empty(n, np.uint16)
    out[order] = crc
    return out


def _number(n: int) -> bytes:
    """A frame number, coded as UTF-8 codes characters, up to 36 bits."""
    if n < 0x80:
        return bytes([n])
    parts = []
    while True:
        parts.append(0x80 | (n & 0x3F))
        n >>= 6
        room = 6 - len(parts)
        if n < (1 << room):
            return bytes([((0xFF << (room + 1)) & 0xFF) | n, *reversed(parts)])


_headers: dict[tuple[int, int], bytes] = {}


def _header(number: int, size: int) -> bytes:
    if (number, size) not in _headers:
        if len(_headers) > 100_000:
            _headers.clear()
        code, extra = (2, b"") if size == BLOCK else (6, bytes([size - 1])) if size <= 256 else (7, struct.pack(">H", size - 1))
        head = bytes([0xFF, 0xF8, code << 4, 0x02]) + _number(number) + extra
        _headers[number, size] = head + bytes([_crc8(head)])
    return _headers[number, size]


#: Predictors tried on each frame: kind code, coefficients (latest sample first), shift. The last one's coefficients have 5 bits.
_TRIED = [(8, (), 0), (9, (1,), 0), (35, (5, 4, 4, 3), 5)]
_PRECISION = 5


def _encode_frames(x: np.ndarray, size: int) -> list[bytes]:
    """Subframes (without header and CRC-16) of frames x[n, size], samples from -128 to 127."""
    n = len(x)
    x = x.astype(np.int32)
    best, cost = np.zeros(n, np.int8), np.full(n, 1 << 60, np.int64)
    kept = []
    for i, (_, coef, shift) in enumerate(_TRIED):
        o = len(coef)
        guess = sum((c * x[:, o - 1 - j : size - 1 - j] for j, c in enumerate(coef)), np.zeros((n, size - o), np.int32)) >> shift
        r = x[:, o:] - guess
        z = (r << 1) ^ (r >> 31)
        kept.append(z)
        total = z.sum(1) + 30 * o
        better = total < cost
        best[better], cost[better] = i, total[better]
    out: list[bytes] = [b""] * n
    flat = (x == x[:, :1]).all(1)
    for i, (kind, coef, shift) in enumerate(_TRIED):
        mine = np.flatnonzero((best == i) & ~flat)
        if not len(mine):
            continue
        o, z = len(coef), kept[i][mine]
        k = np.clip(np.floor(np.log2(np.maximum(z.mean(1) * 0.69, 1))), 0, 14).astype(np.int64)
        for more in (1, -1):
            bits = lambda kk: (z >> kk[:, None]).sum(1) + (kk + 1) * z.shape[1]  # noqa: E731,B023
            other = np.clip(k + more, 0, 14)
            k = np.where(bits(other) < bits(k), other, k)
        fields = [(np.full(len(mine), kind << 1), 8)] + [(x[mine, j] & 0xFF, 8) for j in range(o)]
        if kind >= 32:
            fields += [(np.full(len(mine), _PRECISION - 1), 4), (np.full(len(mine), shift), 5)] + [(np.full(len(mine), c & 31), _PRECISION) for c in coef]
        fields += [(np.zeros(len(mine)), 6), (k, 4)]
        heads = sum(w for _, w in fields)
        lengths = (z >> k[:, None]) + 1 + k[:, None]
        ends = heads + np.cumsum(lengths, 1)
        total = ends[:, -1]
        plain = total >= 8 + 8 * size
        words = -(-total // 32)
        base = np.concatenate(([0], np.cumsum(words)[:-1]))
        low = np.zeros(int(words.sum()) + 1, np.float64)

        def place(value, end, first, low=low):  # bits end before `end`, counted from the frame's first word
            last = end - 1
            at = (first + (last >> 5)).ravel()
            v = value.astype(U).ravel() << (U(31) - (last & 31).astype(U).ravel())
            low += np.bincount(at, weights=(v & U(0xFFFFFFFF)).astype(np.float64), minlength=len(low))
            high = v >> U(32)
            some = high > 0
            low += np.bincount(at[some] - 1, weights=high[some].astype(np.float64), minlength=len(low))

        upto = 0
        for value, w in fields:
            upto += w
            place(np.asarray(value), np.full(len(mine), upto), base)
        place((1 << k[:, None]) | (z & ((1 << k[:, None]) - 1)), ends, base[:, None])
        packed = low.astype(U).astype(">u4").tobytes()
        for j, f in enumerate(mine.tolist()):
            s = int(base[j]) * 4
            out[f] = b"\x02" + (x[f] & 0xFF).astype(np.uint8).tobytes() if plain[j] else packed[s : s + -(-int(total[j]) // 8)]
    for f in np.flatnonzero(flat).tolist():
        out[f] = bytes([0, int(x[f, 0]) & 0xFF])
    return out


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (its bytes less 128 are the 8-bit samples). A payload is a positive multiple of UNIT bytes."""
    frames: list[tuple[int, int, int, int]] = []  # doc, number, offset, size
    for d, p in enumerate(payloads):
        if not p or len(p) % UNIT:
            raise ValueError("a payload is a positive multiple of 192 bytes")
        frames += [(d, i // BLOCK, i, min(BLOCK, len(p) - i)) for i in range(0, len(p), BLOCK)]
    bodies: list[bytes] = [b""] * len(frames)
    for size in {f[3] for f in frames}:
        mine = [i for i, f in enumerate(frames) if f[3] == size]
        for s in range(0, len(mine), CHUNK // size):
            part = mine[s : s + CHUNK // size]
            x = np.frombuffer(b"".join([payloads[frames[i][0]][frames[i][2] : frames[i][2] + size] for i in part]), np.uint8).reshape(-1, size)
            for i, body in zip(part, _encode_frames(x.astype(np.int32) - 128, size), strict=True):
                bodies[i] = body
    bodies = [_header(f[1], f[3]) + b for f, b in zip(frames, bodies, strict=True)]
    lengths = np.array([len(b) for b in bodies], np.int64)
    ends = np.cumsum(lengths)
    sums = crc16(np.frombuffer(b"".join(bodies), np.uint8), ends - lengths, ends).astype(">u2").tobytes()
    out, i = [], 0
    for p in payloads:
        n = -(-len(p) // BLOCK)
        own = [bodies[j] + sums[2 * j : 2 * j + 2] for j in range(i, i + n)]
        i += n
        sizes = [len(f) for f in own]
        points, at = [], 0
        for j, s in enumerate(sizes):
            points.append(struct.pack(">QQH", j * BLOCK, at, min(BLOCK, len(p) - j * BLOCK)))
            at += s
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + ((RATE << 44) | (7 << 36) | len(p)).to_bytes(8, "big") + md5
        table = b"".join(points)
        out.append(b"".join([b"fLaC", bytes([0]), (34).to_bytes(3, "big"), info, bytes([0x83]), len(table).to_bytes(3, "big"), table, *own]))
    return out


class Stream:
    """Where a stream's parts lie."""

    def __init__(self, data: bytes):
        if data[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, last, self.points, self.md5 = 4, False, [], b""
        while not last:
            last, kind, n = bool(data[at] & 0x80), data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
            body = data[at + 4 : at + 4 + n]
            if kind == 0:
                self.block = struct.unpack(">H", body[2:4])[0]
                packed = int.from_bytes(body[10:18], "big")
                self.channels, self.bits, self.samples, self.md5 = ((packed >> 41) & 7) + 1, ((packed >> 36) & 31) + 1, packed & ((1 << 36) - 1), body[18:34]
            elif kind == 3:
                self.points = [p[:2] for p in struct.iter_unpack(">QQH", body) if p[0] != 2**64 - 1]
            at += 4 + n
        self.first, self.end = at, len(data)
        if self.channels != 1 or not 4 <= self.bits <= 16:
            raise ValueError("only one channel of 4 to 16 bits is read")
        if not self.points or self.points[0][0]:
            self.points = [(0, 0), *self.points]


def _frame_head(data: bytes, at: int, block: int) -> tuple[int, int]:
    """(bytes of the header at `at`, samples of its frame); the checksum holds."""
    if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8:
        raise ValueError("no frame where one is due")
    size, rate, lead = data[at + 2] >> 4, data[at + 2] & 15, data[at + 4]
    n = 5
    if lead >= 0xC0:
        n += 8 - (lead ^ 0xFF).bit_length() - 1
    samples = 192 if size == 1 else 576 << (size - 2) if 2 <= size <= 5 else 256 << (size - 8) if size >= 8 else 0
    if size in (6, 7):
        samples = int.from_bytes(data[at + n : at + n + size - 5], "big") + 1
        n += size - 5
    n += {12: 1, 13: 2, 14: 2}.get(rate, 0)
    head = data[at : at + n]
    known = _headers.get((int(lead), samples)) if lead < 0x80 else None
    if known != data[at : at + n + 1] and _crc8(head) != data[at + n]:
        raise ValueError("frame header checksum differs")
    return n + 1, samples


def decode(medias: list[bytes], verify: bool = True) -> list[np.ndarray]:
    """Samples (int16) of each stream."""
    streams = [Stream(m) for m in medias]
    out = [np.empty(s.samples, np.int16) for s in streams]
    buffer = b"".join(medias) + b"\0" * 16
    begins = np.concatenate(([0], np.cumsum([len(m) for m in medias])))
    raw = np.frombuffer(buffer, np.uint8)
    words = np.frombuffer(buffer, ">u4", len(buffer) // 4).astype(U)
    window = (words[:-1] << U(32)) | words[1:]
    lanes = []  # doc, sample, byte position, end sample
    for d, s in enumerate(streams):
        stops = [p[0] for p in s.points[1:]] + [s.samples]
        lanes += [(d, p[0], int(begins[d]) + s.first + p[1], e) for p, e in zip(s.points, stops, strict=True) if p[0] < e]
    while lanes:
        heads = [_frame_head(buffer, lane[2], streams[lane[0]].block) for lane in lanes]
        size = np.array([h[1] for h in heads], np.int64)
        start = np.array([lane[2] for lane in lanes], np.int64)
        bits = np.array([streams[lane[0]].bits for lane in lanes], np.int64)
        ends = np.empty(len(lanes), np.int64)
        for s in np.unique(size).tolist():
            pick = np.flatnonzero(size == s)
            for c in range(0, len(pick), max(1, CHUNK // s)):
                part = pick[c : c + max(1, CHUNK // s)]
                x, upto = _decode_frames(window, (start[part] + [heads[i][0] for i in part]) * 8, bits[part], s)
                ends[part] = (upto + 7) >> 3
                for row, i in zip(x, part.tolist(), strict=True):
                    out[lanes[i][0]][lanes[i][1] : lanes[i][1] + s] = row
        if verify and (crc16(raw, start, ends) != (raw[ends].astype(np.uint16) << np.uint16(8)) + raw[ends + 1]).any():
            raise ValueError("frame checksum differs")
        lanes = [(d, at + int(n), int(e) + 2, stop) for (d, at, _, stop), n, e in zip(lanes, size, ends, strict=True) if at + int(n) < stop]
    for s, x in zip(streams, out, strict=True):
        if verify and any(s.md5) and hashlib.md5((x.astype(np.int8) if s.bits <= 8 else x).tobytes()).digest() != s.md5:
            raise ValueError("stream checksum differs")
    return out


def _decode_frames(window: np.ndarray, p: np.ndarray, bits: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples [frame, size] of frames whose subframe begins at bit p, and the bit behind each."""
    p, n = p.astype(np.int64), len(p)

    def get(p, width):  # width: up to 32, an int or one for each
        w = window[p >> 5] << (p & 31).astype(U)
        return ((w >> U(1)) >> (63 - np.asarray(width)).astype(U)).astype(np.int64)

    def signed(v, width):
        half = np.int64(1) << (width - 1)
        return (v ^ half) - half

    head = get(p, 8)
    if (head & 0x81).any():
        raise ValueError("wasted bits aren't read")
    kind, p = head >> 1, p + 8
    x = np.empty((size, n), np.int16)
    flat, plain = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    if len(flat):
        x[:, flat] = signed(get(p[flat], bits[flat]), bits[flat])
        p[flat] += bits[flat]
    for i in range(size if len(plain) else 0):
        x[i, plain] = signed(get(p[plain], bits[plain]), bits[plain])
        p[plain] += bits[plain]
    lpc = kind >= 32
    order = np.where(lpc, (kind & 31) + 1, np.where((kind >= 8) & (kind <= 12), kind - 8, -1))
    if (order[(kind > 1)] < 0).any():
        raise ValueError("reserved subframe")
    for o in np.unique(order[order >= 0]).tolist():
        for is_lpc in (False, True):
            lane = np.flatnonzero((order == o) & (lpc == is_lpc))
            if len(lane):
                x[:, lane], p[lane] = _decode_residual(get, signed, window, p[lane], bits[lane], size, o, is_lpc)
    return x.T, p


_FIXED = {0: (), 1: (1,), 2: (2, -1), 3: (3, -3, 1), 4: (4, -6, 4, -1)}


def _decode_residual(get, signed, window, p, bits, size, order, is_lpc):
    n = len(p)
    x = np.empty((size, n), np.int64)
    for i in range(order):
        x[i] = signed(get(p, bits), bits)
        p = p + bits
    if is_lpc:
        precision, p = get(p, 4) + 1, p + 4
        shift, p = signed(get(p, 5), 5), p + 5
        coef = []
        for _ in range(order):
            coef.append(signed(get(p, precision), precision))
            p = p + precision
        coef = [int(c[0]) if (c == c[0]).all() else c for c in coef]
        shift = int(shift[0]) if (shift == shift[0]).all() else shift
    else:
        coef, shift = _FIXED[order], 0
    method, parts, p = get(p, 2), get(p + 2, 4), p + 6
    wide, step = 4 + method, size >> parts
    due = np.zeros(n, np.int64)  # the sample at which a lane's next partition begins
    k, raw = np.zeros(n, np.int64), np.full(n, -1, np.int64)
    next_due = order
    first = True
    for i in range(order, size):
        if i == next_due:
            new = np.flatnonzero((due <= i) if not first else np.ones(n, bool))
            k[new] = get(p[new], wide[new])
            p[new] += wide[new]
            escape = new[k[new] == (1 << wide[new]) - 1]
            raw[new] = -1
            if len(escape):
                raw[escape] = get(p[escape], 5)
                p[escape] += 5
            due[new] = np.where(due[new] == 0, step[new], due[new] + step[new])
            next_due, first = int(due.min()), False
            any_raw, k64 = bool((raw >= 0).any()), (63 - k).astype(U)
        # The unary part: zeros before the first one.
        w = window[p >> 5] << (p & 31).astype(U)
        top = w >> U(32)
        if not top.all() or any_raw:
            r = np.zeros(n, np.int64)
            if any_raw:
                esc = np.flatnonzero(raw >= 0)
                some = esc[raw[esc] > 0]
                r[some] = signed(get(p[some], raw[some]), raw[some])
                p[esc] += raw[esc]
            rice = np.flatnonzero(raw < 0)
            q = np.zeros(len(rice), np.int64)
            at = p[rice]
            while True:
                t = (window[at >> 5] << (at & 31).astype(U)) >> U(32)
                zero = t == 0
                q += np.where(zero, 32, 0)
                at = at + np.where(zero, 32, 0)
                if not zero.any():
                    break
            lead = 31 - ((t.astype(np.float64).view(np.int64) >> 52) - 1023)
            q, at = q + lead, at + lead + 1
            u = (q << k[rice]) | get(at, k[rice])
            p[rice] = at + k[rice]
            r[rice] = (u >> 1) ^ -(u & 1)
        else:
            q = 1054 - (top.astype(np.float64).view(np.int64) >> 52)
            p = p + q
            p += 1
            w = window[p >> 5] << (p & 31).astype(U)
            u = (q << k) | ((w >> U(1)) >> k64).astype(np.int64)
            p += k
            r = (u >> 1) ^ -(u & 1)
        if order:
            guess = coef[0] * x[i - 1]
            for j in range(1, order):
                guess += coef[j] * x[i - 1 - j]
            x[i] = r + (guess >> shift)
        else:
            x[i] = r
    return x.astype(np.int16), p


def padded(text: bytes | None) -> bytes:
    """A text's bytes and spaces up to a positive multiple of UNIT."""
    text = text or b""
    return text + b" " * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def _groups(sizes: list[int]) -> list[tuple[int, int]]:
    """Runs of rows of about CHUNK bytes."""
    out, start, held = [], 0, 0
    for i, n in enumerate(sizes):
        if held and held + n > CHUNK:
            out.append((start, i))
            start, held = i, 0
        held += n
    return [*out, (start, len(sizes))] if sizes else out


def store_flac(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents' columns and media (binary): the text's UTF-8 bytes, padded with spaces to a multiple of 192, as a FLAC stream.

    A null or empty text is 192 spaces. A column media is replaced. Rows stay apart whatever they repeat.
    """

    def run(batches):
        for batch in batches:
            payloads = [padded(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            for a, b in _groups([len(p) for p in payloads]):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(encode(payloads[a:b]), pa.binary())], names=["_row", "media"])

    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "media")).alias("_row"), F.col(f"`{text}`").cast("string").alias("_text"))
    return row.mapInArrow(run, row.select("_row").schema.add("media", "binary")).select("_row.*", "media")


def read_blocks(rows: DataFrame, key: str = "doc_id", media: str = "media", block: int = 1 << 16) -> DataFrame:
    """key, first_sample, n_samples, pcm (binary, one signed byte or two little-endian ones a sample): verified blocks of each stream.

    A null stream has no blocks; one that isn't FLAC, or fails a checksum, raises.
    """

    def run(batches):
        for batch in batches:
            held = [(k, m) for k, m in zip(batch.column(0), batch.column(1).to_pylist(), strict=True) if m is not None]
            for a, b in _groups([len(m) for _, m in held]):
                out = []
                for (k, m), x in zip(held[a:b], decode([m for _, m in held[a:b]]), strict=True):
                    x = x.astype(np.int8) if Stream(m).bits <= 8 else x
                    out += [(k.as_py(), s, len(x[s : s + block]), x[s : s + block].tobytes()) for s in range(0, len(x), block)]
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], batch.schema.field(0).type), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int32()), pa.array([o[3] for o in out], pa.binary())], names=[key, "first_sample", "n_samples", "pcm"])

    kind = rows.schema[key].dataType.simpleString()
    return rows.select(key, media).mapInArrow(run, f"{key} {kind}, first_sample long, n_samples int, pcm binary")


def flac_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each document.

    Every text is stored as store_flac does and read back from the stored bytes with all checksums verified; the payload's digests and the
    feature (energy, peak and zero crossings of the samples) come from what was read.
    """

    def run(batches):
        for batch in batches:
            texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
            payloads = [padded(t) for t in texts]
            for a, b in _groups([len(p) for p in payloads]):
                medias = encode(payloads[a:b])
                out: list[list] = [[] for _ in range(7)]
                for t, m, x in zip(texts[a:b], medias, decode(medias), strict=True):
                    back = (x.astype(np.uint8) ^ 0x80).tobytes()
                    wide = x.astype(np.int32)
                    feature = f"energy={int(np.dot(wide, wide.astype(np.int64)))};peak={int(np.abs(wide).max())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"
                    for column, value in zip(out, (len(t), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature), strict=True):
                        column.append(value)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
