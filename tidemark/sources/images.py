"""Packed query images: a reader and a writer of chunked images with filtered rows (PNG, 8 bits, not interlaced).

A file is a row of ``binaryFile``; its pieces are checked by their CRC, the pixel data is inflated and the filters of its rows
are undone. Sums along a row and down a column are cumulative sums; the two filters that need the pixel just before are undone
column by column for all images of a batch that have that filter in a row. One row comes out for each strip of pixels; a file
that can't be read gives one row with its fault and no values.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The signature, and channels by colour type.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
STRIP = "name string, y int, width int, channels int, pixels array<int>, fault string"
MOST_BYTES = 256 << 20  # unpacked size that an image may say it has


def chunks(data: bytes) -> list[tuple[bytes, bytes]]:
    """(type, content) of the chunks of a file."""
    if data[:8] != SIGNATURE:
        raise ValueError("no image")
    out, at = [], 8
    while at < len(data):
        if at + 12 > len(data):
            raise ValueError("cut off")
        (n,), kind = struct.unpack(">I", data[at : at + 4]), data[at + 4 : at + 8]
        body, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4:
            raise ValueError("cut off")
        if zlib.crc32(kind + body) != struct.unpack(">I", crc)[0]:
            raise ValueError("checksum")
        out.append((kind, body))
        at += 12 + n
        if kind == b"IEND":
            return out
    raise ValueError("cut off")


def unpacked(data: bytes) -> tuple[int, np.ndarray]:
    """Channels, and the filtered rows (height x (1 + width * channels) bytes)."""
    parts = chunks(data)
    if not parts or parts[0][0] != b"IHDR" or len(parts[0][1]) != 13:
        raise ValueError("no header")
    width, height, bits, colour, packing, method, interlaced = struct.unpack(">IIBBBBB", parts[0][1])
    if bits != 8 or colour not in CHANNELS or packing or method or interlaced or not width or not height:
        raise ValueError("unsupported")
    size = height * (1 + width * CHANNELS[colour])
    if size > MOST_BYTES:
        raise ValueError("too large")
    try:
        inflate = zlib.decompressobj()
        raw = inflate.decompress(b"".join(b for k, b in parts if k == b"IDAT"), size)
        more = inflate.decompress(inflate.unconsumed_tail, 1) if inflate.unconsumed_tail else b""
    except zlib.error as e:
        raise ValueError("packed data") from e
    if len(raw) != size or more or not inflate.eof:
        raise ValueError("length")
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    if (rows[:, 0] > 4).any():
        raise ValueError("filter")
    return CHANNELS[colour], rows


def unfiltered(rows: np.ndarray, channels: int) -> np.ndarray:
    """Pixels (images x height x width * channels) of filtered rows (images x height x bytes)."""
    count, height, size = rows.shape
    out = np.zeros((count, height, size - 1), np.uint8)
    above = np.zeros((count, size - 1), np.uint8)
    for y in range(height):
        kind, row = rows[:, y, 0], rows[:, y, 1:]
        done = out[:, y]
        for k in np.unique(kind):
            at = np.flatnonzero(kind == k)
            if k == 0:
                done[at] = row[at]
            elif k == 1:
                done[at] = np.cumsum(row[at].reshape(len(at), -1, channels), axis=1, dtype=np.uint8).reshape(len(at), -1)
            elif k == 2:
                done[at] = row[at] + above[at]
            else:
                done[at] = _by_column(row[at], above[at], channels, averaged=k == 3)
        above = done
    return out


def _by_column(row: np.ndarray, above: np.ndarray, channels: int, averaged: bool) -> np.ndarray:
    """The filters whose guess needs the pixel before: the mean of left and above, or of left, above and their corner the one
    nearest to left + above - corner (in this order on ties)."""
    n = row.shape[0]
    row, above = row.reshape(n, -1, channels), above.reshape(n, -1, channels).astype(np.int16)
    out = np.zeros(row.shape, np.uint8)
    left = corner = np.zeros((n, channels), np.int16)
    for x in range(row.shape[1]):
        up = above[:, x]
        if averaged:
            guess = (left + up) >> 1
        else:
            a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
            guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        out[:, x] = (row[:, x] + guess).astype(np.uint8)
        left, corner = out[:, x].astype(np.int16), up
    return out.reshape(n, -1)


def packed(pixels: np.ndarray, filters: np.ndarray | list[int]) -> bytes:
    """A file of pixels (height x width x channels) with a filter for each row."""
    height, width, channels = pixels.shape
    flat = pixels.astype(np.int16).reshape(height, width * channels)
    left, above, corner = (np.zeros_like(flat) for _ in range(3))
    left[:, channels:], above[1:], corner[1:, channels:] = flat[:, :-channels], flat[:-1], flat[:-1, :-channels]
    a, b, c = np.abs(above - corner), np.abs(left - corner), np.abs(left + above - 2 * corner)
    nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
    guesses = np.stack([np.zeros_like(flat), left, above, (left + above) >> 1, nearest])
    filters = np.asarray(filters)
    rows = np.concatenate([filters[:, None], flat - guesses[filters, np.arange(height)]], 1).astype(np.uint8)
    piece = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    header = struct.pack(">IIBBBBB", width, height, 8, {v: k for k, v in CHANNELS.items()}[channels], 0, 0, 0)
    body = zlib.compress(rows.tobytes())
    half = len(body) // 2
    return SIGNATURE + piece(b"IHDR", header) + piece(b"IDAT", body[:half]) + piece(b"IDAT", body[half:]) + piece(b"IEND", b"")


def strips(files: DataFrame, most: int = 64) -> DataFrame:
    """STRIP of files (name, content); ``most`` files are unpacked together."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in STRIP.split(", ")]
        for pdf in (f.iloc[k : k + most] for f in frames for k in range(0, len(f), most)):
            alike: dict[tuple, list[tuple[str, np.ndarray]]] = {}
            faults = []
            for name, data in zip(pdf["name"], pdf["content"]):
                try:
                    channels, rows = unpacked(bytes(data or b""))
                    alike.setdefault((channels, *rows.shape), []).append((name, rows))
                except ValueError as e:
                    faults.append((name, None, None, None, None, str(e)))
            yield pd.DataFrame(faults, columns=names)
            for (channels, height, size), held in alike.items():
                pixels = unfiltered(np.stack([r for _, r in held]), channels)
                for (name, _), image in zip(held, pixels):
                    yield pd.DataFrame([(name, y, (size - 1) // channels, channels, image[y].astype(np.int32), None) for y in range(height)], columns=names)

    return files.select("name", "content").mapInPandas(run, STRIP)


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """STRIP of the images of a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.png").load(path)
    return strips(files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content"))
