"""FLAC columns: bytes as 8-bit samples, stored losslessly and read back block by block.

A stream has the marker, a STREAMINFO block and frames of BLOCK samples (one channel; byte b is sample b - 128).
Written frames use the fixed predictor (order 0 to 2) with the least residual and Rice codes of one
parameter, or a constant or verbatim subframe where that is smaller. The reader also takes fixed predictors up
to order 4, linear predictors up to order 32, and Rice partitions with escape codes. It checks each
frame's CRC-8 and CRC-16 and the stream's MD5 sum, and refuses what fails.

All frames of a piece of a column are coded together: a step of numpy handles the next sample of each frame.

Null texts count as empty; `padded` makes payloads a positive multiple of BLOCK. Columns with null streams
give no blocks.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm.common import pieces, utf8

BLOCK, RATE, PAD = 192, 8000, 32
_HEAD = bytes([0xFF, 0xF8, 0x14, 0x02])  # sync, fixed block size; 192 samples at 8 kHz; one channel of 8 bits


def _crc_table(width: int, polynomial: int) -> np.ndarray:
    out = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        out = np.where(out >> (width - 1) & 1, out << 1 ^ polynomial, out << 1) & ((1 << width) - 1)
    return out.astype(np.uint16)


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crcs(data: np.ndarray, start: np.ndarray, size: np.ndarray, sixteen: bool) -> np.ndarray:
    """The checksum of each range of bytes."""
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    crc = np.zeros(len(start), np.uint16)
    for i in range(int(size[0]) if len(size) else 0):
        n = int(np.searchsorted(-size, -i, "left"))  # ranges with more than i bytes
        byte = data[start[:n] + i]
        crc[:n] = (crc[:n] << 8) ^ _CRC16[crc[:n] >> 8 ^ byte] if sixteen else _CRC8[crc[:n] ^ byte]
    out = np.empty_like(crc)
    out[order] = crc
    return out


def padded(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each range with spaces appended up to a positive multiple of BLOCK."""
    size = np.diff(off)
    to = np.concatenate([[0], np.cumsum(np.maximum(1, -(-size // BLOCK)) * BLOCK)])
    out = np.full(to[-1], PAD, np.uint8)
    out[np.arange(len(data)) + np.repeat(to[:-1] - off[:-1], size)] = data
    return out, to


def _number(n: int) -> bytes:
    """A frame number in the UTF-8 manner, up to 36 bits."""
    if n < 128:
        return bytes([n])
    tail = []
    while n >= (1 << (6 - len(tail))):
        tail.append(n & 63 | 128)
        n >>= 6
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *reversed(tail)])


def _put(bits: np.ndarray, at: np.ndarray, value: np.ndarray, width: int) -> None:
    """Writes the lowest `width` bits of each value at its place."""
    for j in range(width):
        bits[at + j] = value >> (width - 1 - j) & 1


def frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """Frames of the rows of `samples` (int16, BLOCK columns)."""
    n = len(samples)
    orders = [samples]
    for _ in range(2):
        orders.append(np.diff(orders[-1], axis=1))
    best_bits, best_order, best_k = np.full(n, BLOCK * 8 + 8), np.full(n, -1), np.zeros(n, np.int64)
    folded = [np.where(r < 0, -2 * r - 1, 2 * r) for r in orders]
    for order, u in enumerate(folded):
        for k in range(2, 8):
            bits = 8 + 8 * order + 10 + (u >> k).sum(1, dtype=np.int64) + (k + 1) * u.shape[1]
            better = bits < best_bits
            best_bits[better], best_order[better], best_k[better] = bits[better], order, k
    same = (samples == samples[:, :1]).all(1)
    best_bits[same], best_order[same] = 16, -2
    heads = {int(x): _HEAD + _number(int(x)) for x in np.unique(numbers)}
    head = [heads[x] for x in numbers.tolist()]
    hsize = np.array([len(h) for h in head]) + 1
    size = hsize + (best_bits + 7) // 8 + 2
    to = np.concatenate([[0], np.cumsum(size)])
    flat = np.frombuffer(b"".join(h + bytes(s - len(h)) for h, s in zip(head, size.tolist(), strict=True)), np.uint8).copy()
    flat[to[:-1] + hsize - 1] = _crcs(flat, to[:-1], hsize - 1, False)
    bits = np.zeros(to[-1] * 8, np.uint8)
    body = (to[:-1] + hsize) * 8
    kind = np.select([best_order == -2, best_order == -1], [0, 1], 8 + best_order)
    _put(bits, body, kind << 1, 8)
    raw = samples & 255
    if (rows := np.flatnonzero(best_order == -2)).size:
        _put(bits, body[rows] + 8, raw[rows, 0], 8)
    if (rows := np.flatnonzero(best_order == -1)).size:
        _put(bits, (body[rows, None] + 8 + 8 * np.arange(BLOCK)).ravel(), raw[rows].ravel(), 8)
    for order in range(3):
        for k in range(2, 8):
            rows = np.flatnonzero((best_order == order) & (best_k == k))
            if not rows.size:
                continue
            for j in range(order):
                _put(bits, body[rows] + 8 + 8 * j, raw[rows, j], 8)
            at = body[rows] + 8 + 8 * order
            _put(bits, at, np.full(len(rows), k), 10)  # method 0, partition order 0, parameter of 4 bits
            u = folded[order][rows]
            q = (u >> k).astype(np.int64)
            ends = np.cumsum(q + 1 + k, axis=1)
            stop = (at + 10)[:, None] + ends - 1 - k
            bits[stop] = 1
            _put(bits, (stop + 1).ravel(), u.ravel(), k)
    flat |= np.packbits(bits)
    crc = _crcs(flat, to[:-1], size - 2, True)
    flat[to[1:] - 2], flat[to[1:] - 1] = crc >> 8, crc & 255
    data = flat.tobytes()
    return [data[a:b] for a, b in zip(to[:-1].tolist(), to[1:].tolist(), strict=True)]


def encode(data: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A stream for each range of bytes, whose length is a positive multiple of BLOCK."""
    rows = data.reshape(-1, BLOCK).astype(np.int16) - np.int16(128)
    first = off // BLOCK
    numbers = np.arange(len(rows)) - np.repeat(first[:-1], np.diff(first))
    own = frames(rows, numbers)
    signed = (data ^ 128).tobytes()
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        f = own[a:b]
        sizes = [len(x) for x in f]
        info = BLOCK.to_bytes(2) * 2 + min(sizes).to_bytes(3) + max(sizes).to_bytes(3)
        info += (RATE << 44 | 7 << 36 | (b - a) * BLOCK).to_bytes(8) + hashlib.md5(signed[a * BLOCK : b * BLOCK]).digest()
        out.append(b"fLaC" + bytes([0x80, 0, 0, 34]) + info + b"".join(f))
    return out


class _Bits:
    """Reads at a place of its own in each frame."""

    def __init__(self, data: np.ndarray):
        wide = np.zeros(len(data) + 16, np.uint64)
        wide[: len(data)] = data
        self.word = np.zeros(len(data) + 8, np.uint64)  # the 64 bits from each byte on
        for j in range(8):
            self.word |= wide[j : j + len(self.word)] << np.uint64(56 - 8 * j)

    def peek(self, at: np.ndarray) -> np.ndarray:
        """At least 57 bits, at the upper end."""
        return self.word[at >> 3] << (at & 7).astype(np.uint64)

    def unsigned(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        width = np.broadcast_to(np.asarray(width, np.int64), at.shape)
        return np.where(width == 0, 0, self.peek(at) >> (64 - np.maximum(width, 1)).astype(np.uint64)).astype(np.int64)

    def signed(self, at: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        x = self.unsigned(at, width)
        return np.where(x >> np.maximum(np.asarray(width) - 1, 0) & 1, x - (1 << np.asarray(width)), x)

    def unary(self, at: np.ndarray) -> np.ndarray:
        """Zeros before the next one."""
        out = np.zeros(len(at), np.int64)
        rest = np.arange(len(at))
        while rest.size:
            top = (self.peek(at[rest] + out[rest]) >> np.uint64(12)).astype(np.float64)  # 52 bits: exact
            out[rest] += 52 - np.frexp(top)[1]
            rest = rest[top == 0]
        return out


#: Coefficients of the fixed predictors.
_FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]
_SIZES = {1: 192, **{i: 576 << (i - 2) for i in range(2, 6)}, **{i: 256 << (i - 8) for i in range(8, 16)}}


def _header(stream: bytes, at: int, number: int) -> tuple[int, int] | None:
    """Size of the header and samples of the frame, if one of that number begins there."""
    own = _number(number)
    if stream[at : at + 2] != b"\xff\xf8" or stream[at + 4 : at + 4 + len(own)] != own or stream[at + 3] >> 4:
        return None
    size, rate, end = stream[at + 2] >> 4, stream[at + 2] & 15, at + 4 + len(own)
    n = _SIZES.get(size, 0)
    if size in (6, 7):
        n = int.from_bytes(stream[end : end + size - 5]) + 1
        end += size - 5
    end += (rate == 12) + 2 * (rate in (13, 14))
    crc = _crcs(np.frombuffer(stream, np.uint8), np.array([at]), np.array([end - at]), False)[0]
    return (end + 1 - at, n) if end < len(stream) and n and crc == stream[end] else None


_USUAL: dict[int, bytes] = {}


def _usual(number: int) -> bytes:
    """The header that encode() writes, with its CRC-8."""
    if number not in _USUAL:
        if len(_USUAL) > 100_000:
            _USUAL.clear()
        head = _HEAD + _number(number)
        _USUAL[number] = head + bytes([int(_crcs(np.frombuffer(head, np.uint8), np.array([0]), np.array([len(head)]), False)[0])])
    return _USUAL[number]


def _frames(stream: bytes) -> list[tuple[int, int, int]]:
    """Begin, header size and samples of each frame; a header counts where its number and CRC-8 are right."""
    if stream[:4] != b"fLaC":
        raise ValueError("no FLAC stream")
    at, last = 4, False
    while not last:
        last, at = bool(stream[at] & 128), at + 4 + int.from_bytes(stream[at + 1 : at + 4])
    total, out, done = int.from_bytes(stream[18:26]) & ((1 << 36) - 1), [], 0
    while done < total:
        head = _usual(len(out))
        begin = stream.find(head, at)
        found = (len(head), BLOCK) if begin >= 0 else None
        if not found or begin != at and not out:
            begin = at
            while not (found := _header(stream, begin, len(out))):
                begin = stream.find(b"\xff\xf8", begin + 1)
                if begin < 0:
                    raise ValueError("a frame is missing or its header is damaged")
        out.append((begin, *found))
        done += found[1]
        at = begin + found[0]
    return out


def _decode_frames(data: np.ndarray, start: np.ndarray, head: np.ndarray, size: np.ndarray, samples: np.ndarray) -> np.ndarray:
    """PCM bytes, a column for each frame. All frames go on together, sample by sample."""
    stored = data[start + size - 2].astype(np.uint16) << 8 | data[start + size - 1]
    if (_crcs(data, start, size - 2, True) != stored).any():
        raise ValueError("a frame's CRC-16 is wrong")
    bits, n = _Bits(data), len(start)
    at = (start + head) * 8
    kind = bits.unsigned(at, 8) >> 1
    if (bits.unsigned(at, 8) & 129).any():
        raise ValueError("wasted bits aren't supported")
    at += 8
    order = np.select([kind >= 32, kind >= 8], [kind - 31, kind - 8], 0)
    plain = kind == 1
    out = np.zeros((int(samples.max()), n), np.int64)
    warm = np.where(plain, samples, np.where(kind == 0, 1, order))
    for t in range(int(warm.max())):
        own = np.flatnonzero(warm > t)
        out[t, own] = bits.signed(at[own], 8)
        at[own] += 8
    coefficients, shift = np.zeros((max(1, int(order.max())), n), np.int64), np.zeros(n, np.int64)
    for k in range(1, 5):
        if (kind == 8 + k).any():
            coefficients[:k, kind == 8 + k] = np.array(_FIXED[k])[:, None]
    if (linear := np.flatnonzero(kind >= 32)).size:
        width = bits.unsigned(at[linear], 4) + 1
        shift[linear] = bits.unsigned(at[linear] + 4, 5)
        at[linear] += 9
        for j in range(int(order[linear].max())):
            own = order[linear] > j
            coefficients[j, linear[own]] = bits.signed(at[linear[own]], width[own])
            at[linear[own]] += width[own]
    coded = np.flatnonzero(kind >= 8)
    if coded.size:
        wide = 4 + (bits.unsigned(at[coded], 2) == 1)  # bits of a parameter
        part = samples[coded] >> bits.unsigned(at[coded] + 2, 4)
        place, first, length = at[coded] + 6, order[coded], samples[coded]
        k, raw = np.zeros(len(coded), np.int64), np.full(len(coded), -1)
        rows, pred, move = coefficients[:, coded], np.zeros(len(coded), np.int64), shift[coded]
        whole, simple = int(length.min()), True
        for t in range(int(length.max())):
            begins = (t == first) | ((t > first) & (t % part == 0) & (t < length))
            if begins.any():
                own = np.flatnonzero(begins)
                k[own] = bits.unsigned(place[own], wide[own])
                place[own] += wide[own]
                escape = k[own] == (1 << wide[own]) - 1
                raw[own] = np.where(escape, bits.unsigned(place[own], 5), -1)
                place[own] += 5 * escape
                simple = bool((raw < 0).all())
            on = slice(None) if t >= first.max() and t < whole else np.flatnonzero((t >= first) & (t < length))
            p, kk = place[on], k[on]
            q = bits.unary(p)
            u = q << kk | bits.unsigned(p + q + 1, kk)
            residual, used = (u >> 1) ^ -(u & 1), q + 1 + kk
            if not simple:
                r = raw[on]
                residual = np.where(r < 0, residual, np.where(r == 0, 0, bits.signed(p, np.maximum(r, 1))))
                used = np.where(r < 0, used, r)
            place[on] = p + used
            pred = sum((rows[j, on] * out[t - 1 - j, coded[on]] for j in range(min(t, len(rows)))), np.zeros(len(p), np.int64))
            out[t, coded[on]] = residual + (pred >> move[on])
    constant = kind == 0
    out[:, constant] = out[0, constant]
    return (out + 128).astype(np.uint8)


def decode(streams: list[bytes]) -> list[list[tuple[int, bytes]]]:
    """For each stream its blocks: sample offset and PCM bytes (sample plus 128)."""
    found = [_frames(s) for s in streams]
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    rows = [(base[i] + b, h, (f[j + 1][0] if j + 1 < len(f) else len(streams[i])) - b, n) for i, f in enumerate(found) for j, (b, h, n) in enumerate(f)]
    out: list[list[tuple[int, bytes]]] = [[] for _ in streams]
    if rows:
        start, head, size, samples = np.array(rows, np.int64).T
        pcm = np.ascontiguousarray(_decode_frames(np.frombuffer(b"".join(streams), np.uint8), start, head, size, samples).T)
        of, data, width = np.repeat(np.arange(len(found)), [len(f) for f in found]), pcm.tobytes(), pcm.shape[1]
        for j, (i, n) in enumerate(zip(of.tolist(), samples.tolist(), strict=True)):
            done = out[i][-1] if out[i] else (0, b"")
            out[i].append((done[0] + len(done[1]), data[j * width : j * width + n]))
    for s, blocks in zip(streams, out, strict=True):
        signed = (np.frombuffer(b"".join(b for _, b in blocks), np.uint8) ^ 128).tobytes()
        if len(signed) != int.from_bytes(s[18:26]) & ((1 << 36) - 1) or hashlib.md5(signed).digest() != s[26:42]:
            raise ValueError("the samples differ from the stream's MD5 sum")
    return out


def store(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, n_bytes (unpadded) and media: the text's bytes, padded, as a FLAC stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text, 1 << 20):
            data, off = utf8(b, text)
            media = encode(*padded(data, off))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in keep), pa.array(np.diff(off), pa.int64()), pa.array(media, pa.binary())], [*keep, "n_bytes", "media"])

    source = docs.select(*dict.fromkeys((*keep, text)))
    return source.mapInArrow(run, ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep) + ", n_bytes long, media binary")


def blocks(stored: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """`keep` columns, sample_offset, n_samples and pcm: a row for each block, to seek in by its sample offset."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, media, 1 << 20):
            streams = b.column(b.schema.get_field_index(media)).to_pylist()
            has = [i for i, s in enumerate(streams) if s is not None]
            rows = [(i, o, p) for i, own in zip(has, decode([streams[i] for i in has]), strict=True) for o, p in own]
            take = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)).take(take) for k in keep), pa.array([r[1] for r in rows], pa.int64()), pa.array([len(r[2]) for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], [*keep, "sample_offset", "n_samples", "pcm"])

    source = stored.select(*keep, media)
    return source.mapInArrow(run, ", ".join(f"`{k}` {source.schema[k].dataType.simpleString()}" for k in keep) + ", sample_offset long, n_samples int, pcm binary")


def feature(payload: bytes) -> str:
    """Samples, mean, mean square, zero crossings and mean step, all about the level of 128."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    step = np.abs(np.diff(x)).sum() if len(x) > 1 else 0
    return f"{len(x)}:{x.sum()}:{(x * x).sum()}:{int(((x[1:] < 0) != (x[:-1] < 0)).sum())}:{step}"


def digests(docs: DataFrame) -> DataFrame:
    """The texts stored by store(), the streams read back, and digests of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "media", 1 << 20):
            streams = b.column(2).to_pylist()
            payload = [b"".join(p for _, p in own) for own in decode(streams)]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), pa.array([len(p) for p in payload], pa.int64()), pa.array([hashlib.sha256(p).hexdigest() for p in payload], pa.string()), pa.array([zlib.crc32(p[-16:]) for p in payload], pa.int64()),
                    pa.array([len(s) for s in streams], pa.int64()), pa.array([hashlib.sha256(s).hexdigest() for s in streams], pa.string()), pa.array([feature(p) for p in payload], pa.string()),
                ],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    return store(docs).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
