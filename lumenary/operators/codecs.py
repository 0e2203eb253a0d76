"""Image encoders and a PNG decoder on numpy and zlib: PNG, baseline JPEG, TIFF (deflate). No metadata is written."""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The example quantisation tables of the JPEG standard, row by row (luminance, chrominance).
LUMA = """
16 11 10 16 24 40 51 61
12 12 14 19 26 58 60 55
14 13 16 24 40 57 69 56
14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77
24 35 55 64 81 104 113 92
49 64 78 87 103 121 120 101
72 92 95 98 112 100 103 99
"""
CHROMA = """
17 18 24 47 99 99 99 99
18 21 26 66 99 99 99 99
24 26 56 99 99 99 99 99
47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
99 99 99 99 99 99 99 99
"""


def _table(text: str, quality: int) -> np.ndarray:
    base = np.array(text.split(), int).reshape(8, 8)
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return np.clip((base * scale + 50) // 100, 1, 255)


def zigzag() -> np.ndarray:
    """The order of the 64 coefficients: by diagonals, in turns."""
    cells = sorted(((y, x) for y in range(8) for x in range(8)), key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))
    return np.array([8 * y + x for y, x in cells])


def _dct() -> np.ndarray:
    k, n = np.arange(8)[:, None], np.arange(8)[None, :]
    m = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


def _huffman(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Canonical codes of at most 16 bits from symbol counts: symbol -> (code, length). No code is all ones."""
    groups = [(n, k, {s: 0}) for k, (s, n) in enumerate(sorted(counts.items()))] + [(0, 1 << 20, {-1: 0})]  # -1 takes the code of all ones
    if len(groups) == 1:
        groups.append((0, 0, {0: 0}))
    tick = 1 << 21
    while len(groups) > 1:
        groups.sort(key=lambda g: (g[0], -g[1]))
        (a, _, x), (b, _, y) = groups[:2]
        groups[:2] = [(a + b, tick, {s: d + 1 for g in (x, y) for s, d in g.items()})]
        tick += 1
    lengths = groups[0][2]
    by = [0] * 300
    for d in lengths.values():
        by[d] += 1
    for d in range(len(by) - 1, 16, -1):  # too long codes move up in pairs
        while by[d]:
            up = d - 2
            while not by[up]:
                up -= 1
            by[d] -= 2
            by[d - 1] += 1
            by[up + 1] += 2
            by[up] -= 1
    order = sorted((s for s in lengths if s >= 0), key=lambda s: (lengths[s], s))
    sizes = [d for d in range(17) for _ in range(by[d])]
    codes, code, last = {}, 0, sizes[0]
    for s, d in zip(order, sizes):
        code <<= d - last
        codes[s], last = (code, d), d
        code += 1
    return codes


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _categories(v: np.ndarray) -> np.ndarray:
    """Bits of each magnitude."""
    return np.where(v == 0, 0, np.frexp(np.abs(v).astype(float))[1]).astype(np.int64)


def _extra(v: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bits that follow a category: negative values less one, in `size` bits."""
    return np.where(v >= 0, v, v + (1 << size) - 1)


def _pack(value: np.ndarray, length: np.ndarray) -> bytes:
    """The values' lowest bits side by side, filled up with ones."""
    ends = np.cumsum(length)
    total = int(ends[-1])
    at = np.arange(total) - np.repeat(ends - length, length)
    bits = np.ones(-(-total // 8) * 8, np.uint8)
    bits[:total] = np.repeat(value, length) >> (np.repeat(length, length) - 1 - at) & 1
    return np.packbits(bits).tobytes()


def jpeg(image: np.ndarray, quality: int = 92) -> bytes:
    """A baseline JPEG (4:4:4) of an (h, w, 1 or 3) array, with Huffman tables made for it."""
    if not 1 <= quality <= 100:
        raise ValueError(f"quality out of range: {quality}")
    h, w, c = image.shape
    x = image.astype(float)
    if c >= 3:
        r, g, b = x[..., 0], x[..., 1], x[..., 2]
        planes = [0.299 * r + 0.587 * g + 0.114 * b, 128 - 0.168736 * r - 0.331264 * g + 0.5 * b, 128 + 0.5 * r - 0.418688 * g - 0.081312 * b]
    else:
        planes = [x[..., 0]]
    tables, order, m = [_table(LUMA, quality), _table(CHROMA, quality)], zigzag(), _dct()
    blocks = []
    for k, p in enumerate(planes):
        p = np.pad(p, ((0, -h % 8), (0, -w % 8)), mode="edge") - 128
        cells = p.reshape(p.shape[0] // 8, 8, p.shape[1] // 8, 8).transpose(0, 2, 1, 3)
        q = np.rint(m @ cells @ m.T / tables[min(k, 1)]).astype(int)
        blocks.append(q.reshape(-1, 64)[:, order])
    n = len(planes)
    rows = np.stack(blocks, 1).reshape(-1, 64)  # in scan order: a block of each plane in turn
    kind = np.tile(np.minimum(np.arange(n), 1), len(blocks[0])) * 2  # its table for the first coefficient; the next one is for the rest
    first = np.concatenate([np.diff(x[:, 0], prepend=0)[:, None] for x in blocks], 1).reshape(-1)
    at, j = np.nonzero(rows[:, 1:])
    value = rows[at, j + 1]
    run = np.diff(j, prepend=-1) - 1
    begins = np.diff(at, prepend=-1) > 0
    run[begins] = j[begins]
    long = run >> 4  # runs of sixteen, said on their own
    size, size0 = _categories(value), _categories(first)
    many = np.arange(len(rows))
    whole = np.zeros(len(rows), bool)
    whole[at[j == 62]] = True
    ends = many[~whole]
    zeros = np.repeat(np.arange(len(at)), long)
    none = np.zeros(len(zeros), np.int64)
    # (place in the scan, table, symbol, extra bits, their number)
    place = np.concatenate([many * 130, at[zeros] * 130 + 2 * j[zeros] + 1, at * 130 + 2 * j + 2, ends * 130 + 129])
    table = np.concatenate([kind, kind[at[zeros]] + 1, kind[at] + 1, kind[ends] + 1])
    symbol = np.concatenate([size0, none + 0xF0, (run & 15) << 4 | size, np.zeros(len(ends), np.int64)])
    extra = np.concatenate([_extra(first, size0), none, _extra(value, size), np.zeros(len(ends), np.int64)])
    width = np.concatenate([size0, none, size, np.zeros(len(ends), np.int64)])
    order_of = np.argsort(place, kind="stable")
    table, symbol, extra, width = table[order_of], symbol[order_of], extra[order_of], width[order_of]
    counts = np.bincount(table * 256 + symbol, minlength=1024).reshape(4, 256)
    codes = [_huffman({int(s): int(c) for s, c in enumerate(x) if c}) if x.any() else {} for x in counts]
    code, length = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
    for t, x in enumerate(codes):
        for sym, (c, size_) in x.items():
            code[256 * t + sym], length[256 * t + sym] = c, size_
    key = table * 256 + symbol
    data = _pack(code[key] << width | extra, length[key] + width).replace(b"\xff", b"\xff\x00")
    out = b"\xff\xd8" + _segment(0xE0, b"JFIF\0" + struct.pack(">BBBHHBB", 1, 1, 0, 1, 1, 0, 0))
    used = min(2, len(planes))
    for k in range(used):
        out += _segment(0xDB, bytes([k]) + bytes(tables[k].ravel()[order].tolist()))
    out += _segment(0xC0, struct.pack(">BHHB", 8, h, w, len(planes)) + b"".join(bytes([k + 1, 0x11, min(k, 1)]) for k in range(len(planes))))
    for t in range(2 * used):
        listed = sorted(codes[t], key=lambda s: (codes[t][s][1], codes[t][s][0]))
        per = [sum(1 for s in listed if codes[t][s][1] == d) for d in range(1, 17)]
        out += _segment(0xC4, bytes([(t % 2) << 4 | t // 2]) + bytes(per) + bytes(listed))
    out += _segment(0xDA, bytes([len(planes)]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(len(planes))) + b"\x00\x3f\x00")
    return out + data + b"\xff\xd9"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def png(image: np.ndarray, level: int = 6) -> bytes:
    h, w, c = image.shape
    rows = np.zeros((h, 1 + w * c), np.uint8)
    rows[:, 1:] = image.reshape(h, -1)
    colour = {1: 0, 2: 4, 3: 2, 4: 6}[c]
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def tiff(image: np.ndarray) -> bytes:
    """One deflated strip, little-endian."""
    h, w, c = image.shape
    data = zlib.compress(image.tobytes(), 6)
    data += b"\0" * (len(data) % 2)
    bits_at = 8 + len(data)
    tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, c, 8 if c == 1 else bits_at), (259, 3, 1, 8), (262, 3, 1, 1 if c == 1 else 2), (273, 4, 1, 8), (277, 3, 1, c), (278, 4, 1, h), (279, 4, 1, len(data))]
    body = struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags) + struct.pack("<I", 0)
    bits = struct.pack(f"<{c}H", *[8] * c)
    return b"II*\0" + struct.pack("<I", bits_at + len(bits)) + data + bits + body


#: Extensions that are written.
FORMATS = (".jpg", ".jpeg", ".png", ".tif", ".tiff")


def encode(image: np.ndarray, extension: str, quality: int = 92) -> bytes:
    """By extension; others than jpg, png and tiff are not written."""
    kind = extension.lower()
    if kind in (".jpg", ".jpeg"):
        return jpeg(image, quality)
    if kind == ".png":
        return png(image)
    if kind in (".tif", ".tiff"):
        return tiff(image)
    raise ValueError(f"unsupported output format: {extension}")
