"""Difference hashes of images, decoded with the standard library: PNG and BMP of 8 bits a
sample without interlacing; other formats need Pillow, without it they have no hash."""

from __future__ import annotations

import struct
import zlib
from io import BytesIO

from pyspark.sql import functions as F


def _grey(rows, channels: int):
    import numpy as np

    x = np.asarray(rows, np.float64).reshape(len(rows), -1, channels)
    return x[:, :, 0] if channels < 3 else x[:, :, 0] * 0.299 + x[:, :, 1] * 0.587 + x[:, :, 2] * 0.114


def _png(data: bytes):
    import numpy as np

    at, body, head = 8, b"", None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        part, at = data[at + 8 : at + 8 + size], at + 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        body += part if kind == b"IDAT" else b""
    if head is None or head[2] != 8 or head[6] or head[3] not in (0, 2, 4, 6):
        return None
    width, height, channels = head[0], head[1], {0: 1, 2: 3, 4: 2, 6: 4}[head[3]]
    raw, stride = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, -1), width * channels
    out = np.zeros((height, stride), np.int64)
    for y in range(height):
        kind, line, up = raw[y, 0], raw[y, 1:].astype(np.int64), out[y - 1] if y else np.zeros(stride, np.int64)
        if kind in (0, 2):
            out[y] = (line + (up if kind else 0)) & 255
            continue
        for x in range(stride):
            a, b, c = (out[y, x - channels] if x >= channels else 0), up[x], (up[x - channels] if x >= channels else 0)
            if kind == 1:
                more = a
            elif kind == 3:
                more = (a + b) // 2
            else:
                p = a + b - c
                more = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out[y, x] = (line[x] + more) & 255
    return _grey(out, channels)


def _bmp(data: bytes):
    import numpy as np

    offset, width, height, bits, packed = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26]), struct.unpack("<H", data[28:30])[0], struct.unpack("<I", data[30:34])[0]
    if bits not in (24, 32) or packed:
        return None
    stride, n = (width * bits // 8 + 3) // 4 * 4, abs(height)
    rows = np.frombuffer(data, np.uint8, stride * n, offset).reshape(n, stride)[:, : width * bits // 8]
    rows = rows[::-1] if height > 0 else rows
    return _grey(rows.reshape(n, width, bits // 8)[:, :, 2::-1].reshape(n, -1), 3)


def pixels(data: bytes):
    """Grey values of an image, or None if it can't be decoded here."""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
        if data[:2] == b"BM":
            return _bmp(data)
        from PIL import Image  # optional
        import numpy as np

        return np.asarray(Image.open(BytesIO(data)).convert("L"), np.float64)
    except (ImportError, ValueError, IndexError, OSError, struct.error, zlib.error):
        return None


def difference_hash(data: bytes | None, size: int = 8) -> int | None:
    """size * size bits: is a mean of a grid of size + 1 columns above its right neighbour's?
    As a signed 64-bit number, first bit highest."""
    import numpy as np

    grey = pixels(data) if data else None
    if grey is None or not grey.size:
        return None
    ys, xs = (np.linspace(0, n, k + 1) for n, k in zip(grey.shape, (size, size + 1)))
    cuts = lambda edges, n: [(min(int(a), n - 1), max(int(a) + 1, int(np.ceil(b)))) for a, b in zip(edges, edges[1:])]
    grid = np.array([[grey[a:b, c:d].mean() for c, d in cuts(xs, grey.shape[1])] for a, b in cuts(ys, grey.shape[0])])
    value = int("".join("1" if b else "0" for b in (grid[:, :-1] > grid[:, 1:]).ravel()), 2)
    return value - (1 << 64) if value >= 1 << 63 else value


def dhash_udf(size: int = 8):
    """Column function over image contents; null where an image can't be decoded."""

    @F.pandas_udf("long")
    def dhash(content):
        import pandas as pd

        return pd.Series([difference_hash(None if c is None else bytes(c), size) for c in content], dtype="Int64")

    return dhash
