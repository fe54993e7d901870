"""Sizes and pixel deviation of images, from the bytes that Spark's binaryFile source reads."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PNG = b"\x89PNG\r\n\x1a\n"
#: Channels of PNG's colour types: grey, colours, palette, grey with alpha, colours with alpha.
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Bytes of pixels decoded at once, about.
CHUNK = 1 << 20


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    at = 8
    while at + 8 <= len(data):
        n = struct.unpack(">I", data[at : at + 4])[0]
        yield data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        at += 12 + n


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A row of bytes as it was before PNG's filter; step: bytes from a pixel to the next."""
    if kind == 1:
        padded = np.zeros(-(-len(row) // step) * step, np.uint8)
        padded[: len(row)] = row
        return np.cumsum(padded.reshape(-1, step), axis=0, dtype=np.uint8).ravel()[: len(row)]
    if kind == 2:
        return row + above
    if kind in (3, 4):
        out, up = bytearray(row.tobytes()), above.tobytes()
        for i in range(len(out)):
            a, b = out[i - step] if i >= step else 0, up[i]
            if kind == 3:
                guess = (a + b) // 2
            else:
                c = up[i - step] if i >= step else 0
                p = a + b - c
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))
                guess = near[2]
            out[i] = (out[i] + guess) & 255
        return np.frombuffer(bytes(out), np.uint8)
    return row


def png_deviation(data: bytes) -> float:
    """Standard deviation of all colour values (in 8 bits, without alpha), over all channels, row by row; 0 for an interlaced or broken image."""
    head, palette, packed = b"", b"", []
    for name, body in _chunks(data):
        if name == b"IHDR":
            head = body
        elif name == b"PLTE":
            palette = body
        elif name == b"IDAT":
            packed.append(body)
    if len(head) < 13:
        return 0.0
    width, _, depth, colour, _, _, interlaced = struct.unpack(">IIBBBBB", head[:13])
    if interlaced or colour not in CHANNELS or not width:
        return 0.0
    channels = CHANNELS[colour]
    line = -(-width * channels * depth // 8)
    step = max(1, channels * depth // 8)
    table = np.frombuffer(palette, np.uint8).reshape(-1, 3) if colour == 3 and len(palette) % 3 == 0 else None
    above, held, decoder = np.zeros(line, np.uint8), b"", zlib.decompressobj()
    n = total = squares = 0

    def count(row: np.ndarray) -> None:
        nonlocal n, total, squares
        if depth == 16:
            row = row[::2]
        elif depth < 8:
            bits = np.unpackbits(row).reshape(-1, depth)
            row = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(1)[: width * channels]
            row = row if table is not None else row * (255 // ((1 << depth) - 1))
        values = row.astype(np.int64)
        if table is not None:
            values = table[np.minimum(values, len(table) - 1)].astype(np.int64).ravel()
        elif colour in (4, 6):
            values = values.reshape(-1, channels)[:, :-1].ravel()
        n, total, squares = n + len(values), total + int(values.sum()), squares + int((values * values).sum())

    try:
        for body in packed:
            while body:
                held += decoder.decompress(body, CHUNK)
                body = decoder.unconsumed_tail
                at = 0
                while len(held) - at > line:
                    above = _unfiltered(held[at], np.frombuffer(held, np.uint8, line, at + 1), above, step)
                    count(above)
                    at += line + 1
                held = held[at:]
    except zlib.error:
        return 0.0
    return float(np.sqrt(max(0.0, squares / n - (total / n) ** 2))) if n else 0.0


def size(data: bytes) -> tuple[int, int]:
    """Width and height of a PNG or JPEG from its headers; 0 and 0 for all else."""
    if data[:8] == PNG and data[12:16] == b"IHDR" and len(data) >= 24:
        return struct.unpack(">II", data[16:24])
    at = 2 if data[:2] == b"\xff\xd8" else len(data)
    while at + 9 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xFF:  # filling
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD8:  # alone
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):  # start of a frame
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return 0, 0


def image_stats(files: DataFrame) -> DataFrame:
    """path, present, size, width, height, stddev of files (path, content), as text.image_verdict() takes them.

    Content null: not present, all else 0. Pixels are read of PNG alone; of a JPEG, and of what is no image, the deviation is 0, which the
    verdict does not count as flat. A file is held whole, its pixels are not.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, data in zip(frame["path"], frame["content"]):
                data = None if data is None else bytes(data)
                width, height = size(data or b"")
                rows.append((path, data is not None, len(data or b""), width, height, png_deviation(data) if data and data[:8] == PNG and width else 0.0))
            yield pd.DataFrame(rows, columns=["path", "present", "size", "width", "height", "stddev"])

    return files.select(F.col("path").cast("string").alias("path"), "content").mapInPandas(run, "path string, present boolean, size bigint, width bigint, height bigint, stddev double")
