"""Plain PNG files to arrays, within Python workers.

Spark's ``image`` source makes a serializer for every file, some milliseconds each, which for small images is most of a scan. What is
decoded here is an 8-bit grey, RGB or RGBA file with nothing unusual; everything else is None and left to the image source.
"""

from __future__ import annotations

import zlib

import numpy as np

CHANNELS = {0: 1, 2: 3, 6: 4}  # by colour type
NO_PIXELS = {b"tEXt", b"zTXt", b"iTXt", b"tIME", b"pHYs", b"sBIT", b"bKGD", b"sRGB", b"gAMA", b"cHRM"}  # chunks that the image source skips as well
MOST = 16 << 20  # bytes of pixels
SERIAL = 8192  # bytes of rows that are decoded one byte after the other; with more the image source is faster


def decode_png(data: bytes) -> np.ndarray | None:
    """Pixels as ``(h, w, channels)``, or None if the file isn't plain, or not whole."""
    chunks = _chunks(data)
    if chunks is None or len(chunks[0]) != 13:
        return None
    head, body = chunks
    w, h = int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")
    depth, colour, *methods = head[8:]
    if depth != 8 or colour not in CHANNELS or any(methods) or not w or not h:
        return None
    nch = CHANNELS[colour]
    size = h * (1 + w * nch)
    if size > MOST:
        return None
    stream = zlib.decompressobj()
    try:
        raw = stream.decompress(body, size + 1)
    except zlib.error:
        return None
    if len(raw) != size or not stream.eof or stream.unused_data:
        return None
    rows = np.frombuffer(raw, np.uint8).reshape(h, 1 + w * nch)
    rows = _unfiltered(rows[:, 0], rows[:, 1:], nch)
    return None if rows is None else rows.reshape(h, w, nch)


def _chunks(data: bytes) -> tuple[bytes, bytes] | None:
    """The header's and the pixels' bytes, if all chunks are whole and none changes how pixels are read."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or data[12:16] != b"IHDR":
        return None
    head, body, last, at = b"", [], b"", 8
    while at < len(data):
        length, kind = int.from_bytes(data[at : at + 4], "big"), bytes(data[at + 4 : at + 8])
        end = at + 12 + length
        if end > len(data) or zlib.crc32(data[at + 4 : end - 4]) != int.from_bytes(data[end - 4 : end], "big"):
            return None
        if kind == b"IDAT" and (not body or last == kind):
            body.append(data[at + 8 : end - 4])
        elif kind == b"IHDR" and at == 8:
            head = data[at + 8 : end - 4]
        elif kind == b"IEND":
            return (head, b"".join(body)) if end == len(data) else None
        elif kind not in NO_PIXELS:
            return None
        last, at = kind, end
    return None


def _unfiltered(kinds: np.ndarray, rows: np.ndarray, nch: int) -> np.ndarray | None:
    """Rows as stored (0), or as differences to the left (1), above (2), their mean (3) or the nearest of three neighbours (4)."""
    if not kinds.any():
        return rows
    if kinds.max() > 4 or int((kinds > 2).sum()) * rows.shape[1] > SERIAL:
        return None
    out = np.array(rows)
    above = np.zeros(rows.shape[1], np.uint8)
    for row, kind in zip(out, kinds.tolist()):
        if kind == 1:
            row[:] = np.cumsum(row.reshape(-1, nch), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row += above
        elif kind > 2:
            row[:] = _serial(row, above, nch, kind)
        above = row
    return out


def _serial(row: np.ndarray, above: np.ndarray, nch: int, kind: int) -> np.ndarray:
    out, up = bytearray(nch) + row.tobytes(), bytes(nch) + above.tobytes()
    for i in range(nch, len(out)):
        a, b = out[i - nch], up[i]
        if kind == 3:
            guess = a + b >> 1
        else:
            c = up[i - nch]
            left, over, across = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if left <= over and left <= across else b if over <= across else c
        out[i] = out[i] + guess & 255
    return np.frombuffer(out, np.uint8)[nch:]
