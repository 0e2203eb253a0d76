"""Headlines embedded in images: IPTC in JPEG application segments, TIFF tags, PNG profiles and WebP chunks."""

from __future__ import annotations

import struct
import zlib

HEADLINE = (2, 105)


def iim_headline(data: bytes) -> str | None:
    """The last headline of an IIM stream. Damaged data raise ValueError."""
    at, found = 0, None
    while at < len(data) and data[at] == 0x1C:
        if at + 5 > len(data):
            raise ValueError("short record")
        record, number, size = data[at + 1], data[at + 2], struct.unpack(">H", data[at + 3 : at + 5])[0]
        at += 5
        if size & 0x8000:
            n = size & 0x7FFF
            size = int.from_bytes(data[at : at + n], "big")
            at += n
        if at + size > len(data):
            raise ValueError("short value")
        if (record, number) == HEADLINE:
            raw = data[at : at + size]
            try:
                found = raw.decode()
            except UnicodeDecodeError:
                found = raw.decode("latin-1")
        at += size
    return found


def _resources(data: bytes) -> str | None:
    """From image resource blocks: the IPTC block's headline."""
    at, found = 0, None
    while data[at : at + 4] == b"8BIM":
        number, n = struct.unpack(">HB", data[at + 4 : at + 7])
        at += 6 + (n + 1 + (n + 1) % 2)
        (size,) = struct.unpack(">I", data[at : at + 4])
        at += 4
        if number == 0x0404:
            found = iim_headline(data[at : at + size]) or found
        at += size + size % 2
    return found


def _jpeg(data: bytes) -> str | None:
    at, found = 2, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker in (0xD9, 0xDA):
            break
        (size,) = struct.unpack(">H", data[at + 2 : at + 4])
        body = data[at + 4 : at + 2 + size]
        if marker == 0xED and body.startswith(b"Photoshop 3.0\0"):
            found = _resources(body[14:]) or found
        at += 2 + size
    return found


def _tiff(data: bytes) -> str | None:
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    (at,) = struct.unpack(order + "I", data[4:8])
    (n,) = struct.unpack(order + "H", data[at : at + 2])
    for k in range(n):
        tag, kind, count, value = struct.unpack(order + "HHII", data[at + 2 + 12 * k : at + 14 + 12 * k])
        if tag == 33723:
            return iim_headline(data[value : value + count * (4 if kind == 4 else 1)])
    return None


def _png(data: bytes) -> str | None:
    at = 8
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"zTXt" and body.startswith(b"Raw profile type iptc\0"):
            lines = zlib.decompress(body.split(b"\0", 1)[1][1:]).split(b"\n")
            raw = bytes.fromhex(b"".join(lines[3:]).decode())
            return _resources(raw) if raw.startswith(b"8BIM") else iim_headline(raw)
        at += 12 + size
    return None


def _webp(data: bytes) -> str | None:
    """A WebP file is RIFF chunks; IPTC stands in the TIFF structure of its EXIF chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("no WebP file")
    at, found = 12, None
    while at + 8 <= len(data):
        kind, size = struct.unpack("<4sI", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"EXIF":
            found = _tiff(body.removeprefix(b"Exif\0\0")) or found
        at += 8 + size + size % 2
    return found


def embedded_headline(data: bytes | None, kind: str | None) -> str:
    """The headline in an image of the kind its extension names; '' if there is none or the data are damaged."""
    read = {"jpeg": _jpeg, "tiff": _tiff, "png": _png, "webp": _webp}.get(kind or "")
    if not data or read is None:
        return ""
    try:
        return read(bytes(data)) or ""
    except (ValueError, struct.error, IndexError, KeyError, zlib.error):
        return ""
