"""Media columns: payloads stored as baseline JPEG images and read back in numpy.

Encoding is lossless because it starts at the format's own unit, the quantised coefficient: each 64 payload bytes are
the 64 zigzag coefficients of one 8x8 block, with a quantisation table of ones. A byte's coefficient is its rank in ``RANKS``,
counted outwards from zero and never zero, so that bytes that are common in text get short codes. The file is an ordinary
baseline JPEG: SOI, APP0, COM, DQT, SOF0, DRI, two DHT segments, one grayscale scan, EOI. A restart marker after every block
makes the blocks independent.

Decoding parses the markers of any baseline JPEG, takes the stuffed bytes out and cuts the scan at its restart markers. The
intervals, also those of many images with the same tables, are then Huffman-decoded in step: each numpy operation takes one symbol
of every interval, by a 16-bit lookup table made from the file's own DHT segments. Component sampling, zero runs, end-of-block marks
and scans without restart markers are read the same way (one interval then). The luminance thumbnail takes one pixel from each
block's DC coefficient.

Images are encoded and decoded in parts of ``PART`` bytes, so that beside a text and its image no more than a few parts are held.

Defined results: a null text is an empty payload, which is padded to 64 zero bytes; equal texts give equal values;
an empty table gives an empty result. Corrupt images raise ValueError.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, small_batches

UNIT = 64
PART = 1 << 20
# Bytes that are common in text, most common first; all others follow by value.
COMMON = b" etaoinshrdlucmfwypvbgkjqxz\n.,"
RANKS = [*COMMON, *(b for b in range(256) if b not in COMMON)]
#: Code lengths of the size categories, for DC and AC alike; none of the codes is all ones.
LENGTHS = {1: 2, 2: 2, 3: 2, 4: 3, 5: 4, 6: 5, 7: 6, 8: 7}


def _codes(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol -> (code, length) of the canonical Huffman code with these lengths."""
    code, last, out = 0, 0, {}
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


def _field_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per byte its coefficient, and the bits (code of the size category, then the extra bits) and their number."""
    codes = _codes(LENGTHS)
    coef, bits, width = np.zeros(256, np.int16), np.zeros(256, np.uint32), np.zeros(256, np.int64)
    for r, b in enumerate(RANKS):
        v = (r // 2 + 1) * (1 if r % 2 == 0 else -1)
        s = abs(v).bit_length()
        coef[b], bits[b], width[b] = v, codes[s][0] << s | (v if v > 0 else v + (1 << s) - 1), codes[s][1] + s
    return coef, bits, width


_COEF, _BITS, _WIDTH = _field_tables()
_BYTE = np.full(257, -1, np.int16)
_BYTE[_COEF.astype(np.int64) + 128] = np.arange(256)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: (x[1], x[0]))
    counts = bytes(sum(n == k for _, n in order) for k in range(1, 17))
    return _segment(0xC4, bytes([kind]) + counts + bytes(s for s, _ in order))


_TABLES = _segment(0xDB, b"\0" + b"\1" * 64)
_HUFFMAN = _dht(0x00, LENGTHS) + _dht(0x10, LENGTHS)


def _pack(data: np.ndarray, number: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The scan bytes of blocks (rows of 64 payload bytes), and where each block's end.

    ``number`` is a block's place in its image, for its restart marker; ``last`` says that it has none.
    """
    width = _WIDTH[data]
    ends = np.cumsum(width, 1)
    bits = ends[:, -1]
    size = (bits + 7) >> 3
    first = np.cumsum(size) - size
    at = (first[:, None] * 8 + ends - width).reshape(-1)
    width = width.reshape(-1)
    x = _BITS[data.reshape(-1)].astype(np.int64) << (24 - (at & 7) - width)  # a field of at most 15 bits is within three bytes
    at >>= 3
    total = int(size.sum())
    out = np.bincount(at, x >> 16, total + 2) + np.bincount(at + 1, x >> 8 & 255, total + 2) + np.bincount(at + 2, x & 255, total + 2)
    raw = out[:total].astype(np.uint8)
    raw[first + size - 1] |= ((1 << (size * 8 - bits)) - 1).astype(np.uint8)  # the last byte is filled up with ones
    full = raw == 255
    grown = np.cumsum(full)
    marks = np.cumsum(~last) - ~last  # markers before each block
    place = np.arange(total) + grown - full + np.repeat(2 * marks, size)
    scan = np.zeros(total + int(grown[-1]) + 2 * int((~last).sum()), np.uint8)
    scan[place] = raw
    end = first + size + grown[first + size - 1] + 2 * marks
    mark = end[~last]
    scan[mark], scan[mark + 1] = 0xFF, 0xD0 + number[~last] % 8
    return scan, end + 2 * ~last


def _grid(blocks: int) -> tuple[int, int]:
    wide = min(8191, math.isqrt(blocks - 1) + 1)
    return wide, -(-blocks // wide)


def _head(n_bytes: int, wide: int, high: int) -> bytes:
    head = b"\xff\xd8" + _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0") + _segment(0xFE, b"payload-bytes %d" % n_bytes) + _TABLES
    return head + _segment(0xC0, struct.pack(">BHHB", 8, high * 8, wide * 8, 1) + b"\1\x11\0") + _segment(0xDD, b"\0\1") + _HUFFMAN + _segment(0xDA, b"\1\1\0\0\x3f\0")


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A baseline JPEG for each payload, whose length is a positive multiple of 64."""
    out, some, size = [], [], 0
    for p in payloads:
        if not p or len(p) % UNIT:
            raise ValueError("the payload's length must be a positive multiple of 64")
        if len(p) > 8191 * 8191 * UNIT:
            raise ValueError(f"a payload of {len(p)} bytes exceeds one image of 65528 x 65528 samples")
        some.append(p)
        size += len(p)
        if size >= PART:
            out += _encode(some)
            some, size = [], 0
    return out + (_encode(some) if some else [])


def _encode(payloads: list[bytes]) -> list[bytes]:
    grids = [_grid(len(p) // UNIT) for p in payloads]
    if len(payloads) == 1 and len(payloads[0]) > PART:
        return [_encode_long(payloads[0], *grids[0])]
    many = np.array([w * h for w, h in grids])
    data = np.zeros((int(many.sum()), UNIT), np.uint8)
    starts = np.cumsum(many) - many
    for p, a in zip(payloads, starts.tolist()):
        data[a : a + len(p) // UNIT] = np.frombuffer(p, np.uint8).reshape(-1, UNIT)
    number = np.arange(len(data)) - np.repeat(starts, many)
    scan, ends = _pack(data, number, number == np.repeat(many, many) - 1)
    raw, cuts = scan.tobytes(), ends[starts + many - 1].tolist()
    return [_head(len(p), w, h) + raw[a:b] + b"\xff\xd9" for p, (w, h), a, b in zip(payloads, grids, [0, *cuts], cuts)]


def _encode_long(payload: bytes, wide: int, high: int) -> bytes:
    out, whole = [_head(len(payload), wide, high)], wide * high
    step = PART // UNIT
    for a in range(0, whole, step):
        number = np.arange(a, min(a + step, whole))
        data = np.zeros((len(number), UNIT), np.uint8)
        part = np.frombuffer(payload, np.uint8, offset=min(a * UNIT, len(payload)), count=max(0, min(step * UNIT, len(payload) - a * UNIT)))
        data.reshape(-1)[: len(part)] = part
        out.append(_pack(data, number, number == whole - 1)[0].tobytes())
    return b"".join([*out, b"\xff\xd9"])


def encode_payload(payload: bytes) -> bytes:
    return encode_payloads([payload])[0]


class Image:
    """The parsed segments of a baseline JPEG."""

    def __init__(self, data: bytes):
        if data[:2] != b"\xff\xd8":
            raise ValueError("no SOI marker")
        self.quant, self.huffman, self.parts, self.comments, self.restart = {}, {}, [], [], 0
        at = 2
        while True:
            if at + 4 > len(data) or data[at] != 0xFF:
                raise ValueError(f"a marker should stand at byte {at}")
            marker = data[at + 1]
            if marker == 0xFF:
                at += 1
                continue
            n = struct.unpack_from(">H", data, at + 2)[0]
            body = data[at + 4 : at + 2 + n]
            at += 2 + n
            if marker == 0xDB:
                while body:
                    wide = body[0] >> 4
                    self.quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else "u1").astype(np.int32)
                    body = body[65 + 64 * wide :]
            elif marker == 0xC4:
                while body:
                    n_codes = sum(body[1:17])
                    self.huffman[body[0]] = body[1 : 17 + n_codes]
                    body = body[17 + n_codes :]
            elif marker == 0xC0:
                _, self.height, self.width, n_parts = struct.unpack_from(">BHHB", body)
                self.parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n_parts)]
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDA:
                self.tables = {body[1 + 2 * i]: (body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])}
                break
            elif 0xC0 < marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
                raise ValueError("only baseline JPEG is read")
        end = data.rfind(b"\xff\xd9")
        if end < at or not self.parts:
            raise ValueError("no EOI marker or no frame")
        self.scan = memoryview(data)[at:end]
        single = len(self.parts) == 1
        self.h_max, self.v_max = max(p[1] for p in self.parts), max(p[2] for p in self.parts)
        self.mcus = (-(-self.width // 8), -(-self.height // 8)) if single else (-(-self.width // (8 * self.h_max)), -(-self.height // (8 * self.v_max)))
        #: For each block of an MCU: its component, and the bodies of its DC and AC tables.
        self.plan = tuple((n, self.huffman[self.tables[c][0]], self.huffman[0x10 | self.tables[c][1]]) for n, (c, h, v, _) in enumerate(self.parts) for _ in range(1 if single else h * v))

    def parts_decoded(self) -> Iterator[np.ndarray]:
        """Quantised zigzag coefficients (MCU, block of the MCU, 64), some intervals at a time."""
        total, done, at = self.mcus[0] * self.mcus[1], 0, 0
        while done < total:
            part, at = _next_part(self.scan, at) if self.restart else (self.scan, len(self.scan))
            clean, starts, ends, marks = _intervals(np.frombuffer(part, np.uint8))
            per = self.restart or total
            if done + (len(starts) - 1) * per >= total:
                raise ValueError("the scan has too many intervals")
            if at >= len(self.scan) and done + len(starts) * per < total:
                raise ValueError("the scan ends early")
            if (marks != (done // per + np.arange(len(marks))) % 8).any():
                raise ValueError("a restart marker is out of order")
            many = np.minimum(per, total - done - per * np.arange(len(starts)))
            yield _decode(clean, starts, ends, self.plan, many)
            done += int(many.sum())

    def luminance(self) -> tuple[np.ndarray, int, int]:
        """Quantised zigzag coefficients (blocks, 64) of the first component in raster order, and its grid (wide, high)."""
        return self._raster(np.concatenate(list(self.parts_decoded())))

    def _raster(self, coefs: np.ndarray) -> tuple[np.ndarray, int, int]:
        (wide, high), (_, h, v, _) = self.mcus, self.parts[0]
        if len(self.parts) == 1:
            return coefs.reshape(-1, 64), wide, high
        own = coefs[:, : h * v].reshape(high, wide, v, h, 64).transpose(0, 2, 1, 3, 4).reshape(high * v, wide * h, 64)
        keep_w, keep_h = -(-(-(-self.width * h // self.h_max)) // 8), -(-(-(-self.height * v // self.v_max)) // 8)
        return own[:keep_h, :keep_w].reshape(-1, 64), keep_w, keep_h

    def pixels(self, dc: np.ndarray) -> np.ndarray:
        """8-bit luminance of DC coefficients."""
        return np.clip((dc.astype(np.int32) * int(self.quant[self.parts[0][3]][0]) + 4) // 8 + 128, 0, 255).astype(np.uint8)

    def thumbnail(self) -> tuple[np.ndarray, np.ndarray]:
        """(one 8-bit luminance pixel for each block, the quantised coefficients)."""
        coefs, wide, high = self.luminance()
        return self.pixels(coefs[:, 0].reshape(high, wide)), coefs

    def payload_bytes(self) -> int:
        note = next((c for c in self.comments if c.startswith(b"payload-bytes ")), None)
        if note is None:
            raise ValueError("the image holds no payload")
        return int(note.split()[1])


def _next_part(scan: memoryview, at: int) -> tuple[memoryview, int]:
    """About ``PART`` bytes of a scan, up to a restart marker, and where the next begin."""
    end = at + PART
    if end >= len(scan):
        return scan[at:], len(scan)
    a = np.frombuffer(scan[at:end], np.uint8)
    marks = np.flatnonzero((a[:-1] == 255) & (a[1:] >= 0xD0) & (a[1:] <= 0xD7))
    while not len(marks):
        end = min(end + PART, len(scan))
        a = np.frombuffer(scan[at:end], np.uint8)
        marks = np.flatnonzero((a[:-1] == 255) & (a[1:] >= 0xD0) & (a[1:] <= 0xD7))
        if end == len(scan) and not len(marks):
            return scan[at:], len(scan)
    cut = at + int(marks[-1]) + 2
    return scan[at:cut], cut


def _intervals(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entropy-coded bytes without stuffing and markers, where the intervals start and end in them, and the markers' numbers."""
    ff = a[:-1] == 255
    mark = ff & (a[1:] >= 0xD0) & (a[1:] <= 0xD7)
    keep = np.ones(len(a), bool)
    keep[1:] &= ~(ff & (a[1:] == 0)) & ~mark
    keep[:-1] &= ~mark
    at = np.flatnonzero(mark)
    before = np.cumsum(keep)
    cuts = before[at]  # kept bytes up to a marker
    n = int(before[-1]) if len(a) else 0
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [n]])
    if len(cuts) and cuts[-1] == n:  # the bytes end with a marker
        starts, ends = starts[:-1], ends[:-1]
    return a[keep], starts, ends, a[at + 1] - 0xD0


_lookups: dict[bytes, np.ndarray] = {}


def _lookup(table: bytes) -> np.ndarray:
    """For every 16 bits: the symbol of the code at their start, shifted left by 8, and the code's length; -1 for no code."""
    if table not in _lookups:
        if len(_lookups) > 15:
            _lookups.clear()
        lengths, k = {}, 16
        for n, c in enumerate(table[:16], 1):
            for s in table[k : k + c]:
                lengths[s] = n
            k += c
        out = np.full(1 << 16, -1, np.int32)
        for s, (code, n) in _codes(lengths).items():
            out[code << (16 - n) : (code + 1) << (16 - n)] = s << 8 | n
        _lookups[table] = out
    return _lookups[table]


def _decode(clean: np.ndarray, starts: np.ndarray, ends: np.ndarray, plan: tuple, many: np.ndarray) -> np.ndarray:
    """Coefficients (MCU, block of the MCU, 64) of all intervals, whose MCUs are ``many``, decoded in step."""
    pad = np.concatenate([clean, np.full(16, 255, np.uint8)])
    words = np.zeros(len(clean) + 9, np.uint64)
    for k in range(8):
        words <<= np.uint64(8)
        words |= pad[k : k + len(words)]
    out = np.zeros((len(starts), int(many.max()), len(plan), 64), np.int16)
    at, limit = starts * 8, ends * 8
    last = np.zeros((max(p[0] for p in plan) + 1, len(starts)), np.int64)
    for m in range(out.shape[1]):
        live = np.flatnonzero(many > m)
        for j, (part, dc, ac) in enumerate(plan):
            at[live], diff, _ = _symbols(words, at[live], _lookup(dc), False)
            last[part, live] += diff
            block = out[live, m, j]
            block[:, 0] = last[part, live]
            _ac(words, at, live, _lookup(ac), block)
            out[live, m, j] = block
        if (at > limit).any():
            raise ValueError("an interval of the scan is too short")
    if (limit - at >= 8).any():
        raise ValueError("an interval of the scan is too long")
    return out.reshape(-1, len(plan), 64) if (many == out.shape[1]).all() else np.concatenate([o[:n] for o, n in zip(out, many.tolist())])


def _symbols(words: np.ndarray, at: np.ndarray, table: np.ndarray, runs: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One symbol and its extra bits at each bit position: the next positions, the values, and the symbols."""
    if len(at) and int(at.max()) >> 3 >= len(words):
        raise ValueError("the scan ends within a block")
    x = words[at >> 3] << (at & 7).astype(np.uint64)
    found = table[(x >> np.uint64(48)).astype(np.int64)]
    if len(found) and int(found.min()) < 0:
        raise ValueError("no such Huffman code")
    n, symbol = found & 255, found >> 8
    s = symbol & 15 if runs else symbol
    top = x << n.astype(np.uint64)
    extra = np.where(s > 0, top >> (64 - np.maximum(s, 1)).astype(np.uint64), 0).astype(np.int64)
    half = np.int64(1) << np.maximum(s.astype(np.int64) - 1, 0)
    value = np.where((s > 0) & (extra < half), extra - 2 * half + 1, extra)
    return at + n + s, value, symbol


def _ac(words: np.ndarray, at: np.ndarray, live: np.ndarray, table: np.ndarray, block: np.ndarray) -> None:
    """The AC coefficients of one block of each live interval; moves their positions on."""
    row, k, pos = np.arange(len(live)), np.ones(len(live), np.int64), at[live]
    while len(row):
        pos_, value, symbol = _symbols(words, pos, table, True)
        run, size = symbol >> 4, symbol & 15
        if (run == 0).all() and (size > 0).all():  # no zeros anywhere
            if (k == k[0]).all():
                block[row if len(row) < len(block) else slice(None), k[0]] = value
            else:
                block[row, k] = value
            k, pos, stop = k + 1, pos_, None
        else:
            zeros = size == 0
            stop = zeros & (run != 15)
            k = k + np.where(zeros, 16 * (run == 15), run)
            put = ~zeros
            if (k[put] > 63).any():
                raise ValueError("a block has too many coefficients")
            block[row[put], k[put]] = value[put]
            k, pos = k + put, pos_
        over = k >= 64 if stop is None else stop | (k >= 64)
        if over.any():
            at[live[row[over]]] = pos[over]
            row, k, pos = row[~over], k[~over], pos[~over]


def stored_payload(image: Image, coefs: np.ndarray) -> bytes:
    """The payload that ``encode_payload`` stored, from the decoded coefficients."""
    c = coefs.reshape(-1)[: image.payload_bytes()].astype(np.int64)
    if len(c) and int(np.abs(c).max()) > 128:
        raise ValueError("a coefficient stands for no byte")
    out = _BYTE[c + 128]
    if (out < 0).any():
        raise ValueError("a coefficient stands for no byte")
    return out.astype(np.uint8).tobytes()


def read_images(media: list[bytes]) -> Iterator[tuple[Image, np.ndarray, Iterator[bytes]]]:
    """Per stored image: the image, its thumbnail, and the payload in parts. Small images with the same tables are decoded together."""
    some, size = [], 0
    for data in media:
        image = Image(data)
        alike = not some or (image.plan == some[0].plan and image.restart == some[0].restart)
        if some and (size > PART or not alike):
            yield from _read_together(some)
            some, size = [], 0
        if len(image.scan) > PART or not image.restart or len(image.parts) > 1:
            if some:
                yield from _read_together(some)
                some, size = [], 0
            yield _read_long(image)
        else:
            some.append(image)
            size += len(image.scan)
    if some:
        yield from _read_together(some)


def _read_together(images: list[Image]) -> Iterator[tuple[Image, np.ndarray, list[bytes]]]:
    """One scan with a made-up marker between two images."""
    per = images[0].restart
    counts = [-(-i.mcus[0] * i.mcus[1] // per) for i in images]
    clean, starts, ends, marks = _intervals(np.frombuffer(b"\xff\xd0".join(i.scan for i in images), np.uint8))
    if len(starts) != sum(counts):
        raise ValueError("a scan has too many or too few intervals")
    first = np.cumsum(counts) - counts
    number = np.arange(len(starts)) - np.repeat(first, counts)
    inner = number[1:] > 0
    if (marks[: len(starts) - 1][inner] != (number[1:][inner] - 1) % 8).any():
        raise ValueError("a restart marker is out of order")
    total = np.array([i.mcus[0] * i.mcus[1] for i in images])
    many = np.minimum(per, np.repeat(total, counts) - per * number)
    coefs = _decode(clean, starts, ends, images[0].plan, many).reshape(-1, 64)
    for image, b in zip(images, np.cumsum(total).tolist()):
        own = coefs[b - image.mcus[0] * image.mcus[1] : b]
        yield image, image.pixels(own[:, 0].reshape(image.mcus[::-1])), [stored_payload(image, own)]


def _read_long(image: Image) -> tuple[Image, np.ndarray, list[bytes]]:
    if len(image.parts) > 1:
        thumb, coefs = image.thumbnail()
        return image, thumb, [stored_payload(image, coefs)]
    dc, payload, left = [], [], image.payload_bytes()
    for part in image.parts_decoded():
        flat = part.reshape(-1, 64)
        dc.append(flat[:, 0].copy())
        take = flat.reshape(-1)[:left]
        left -= len(take)
        if len(take):
            c = take.astype(np.int64)
            if int(np.abs(c).max()) > 128 or (_BYTE[c + 128] < 0).any():
                raise ValueError("a coefficient stands for no byte")
            payload.append(_BYTE[c + 128].astype(np.uint8).tobytes())
    return image, image.pixels(np.concatenate(dc).reshape(image.mcus[::-1])), payload


def thumbnail_hash(thumb: np.ndarray) -> str:
    """64-bit difference hash: the thumbnail averaged to 8 x 9 cells, each compared with its right neighbour."""
    h, w = thumb.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = thumb.astype(np.float64).cumsum(0).cumsum(1)
    y0, x0 = np.arange(8) * h // 8, np.arange(9) * w // 9
    y1, x1 = np.maximum(y0 + 1, np.arange(1, 9) * h // 8), np.maximum(x0 + 1, np.arange(1, 10) * w // 9)
    sums = s[y1][:, x1] - s[y0][:, x1] - s[y1][:, x0] + s[y0][:, x0]
    mean = sums / np.outer(y1 - y0, x1 - x0)
    return np.packbits(mean[:, 1:] > mean[:, :-1]).tobytes().hex()


def with_media(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Columns ``id_col``, n_bytes and media: each text's padded UTF-8 payload as a JPEG."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for t in b.column(1).to_pylist():
                raw = t or b""
                sizes.append(len(raw))
                media.append(raw + bytes(-len(raw) % UNIT if raw else UNIT))
            media = encode_payloads(media)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = df.select(quoted(id_col).alias("id"), F.encode(quoted(text_col), "utf-8").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, width int, height int, thumb_width int, thumb_height int, feature string"


def media_features(df: DataFrame, id_col: str, media_col: str = "media") -> DataFrame:
    """``id_col``, n_bytes and FEATURES, all computed from the stored JPEG bytes."""
    small_batches(df.sparkSession)
    kind = df.schema[id_col].dataType.simpleString()
    names = ["id", "n_bytes", *[x.split()[0] for x in FEATURES.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, stored = [], b.column(2).to_pylist()
            for media, (image, thumb, payload) in zip(stored, read_images(stored)):
                digest, (h, w) = hashlib.sha256(), thumb.shape
                for part in payload:
                    digest.update(part)
                rows.append((sum(map(len, payload)), digest.hexdigest(), zlib.crc32(b"".join(payload[-2:])[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), image.width, image.height, w, h, f"{image.width}x{image.height}:{thumbnail_hash(thumb)}"))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()]
            cols = list(zip(*rows)) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names)

    rows = df.select(quoted(id_col).alias("id"), "n_bytes", quoted(media_col).alias("media"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, {FEATURES}").withColumnRenamed("id", id_col)
