"""Media columns: bytes kept as PNG images in binary columns, read back and hashed.

The writer filters each scan line by one of five types and deflates them into chunks with CRC-32 checksums; the reader
tests every checksum, inflates, and undoes the filters of many images' lines at once in numpy. The feature of an image is the
sign pattern of its low-frequency cosine transform. Both work row by row and need no shuffle.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame

from .common import utf8, with_results

#: Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}

UNIT = 576
READ = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def filter_lines(pixels: np.ndarray, filter_type: int, above: np.ndarray | None = None) -> np.ndarray:
    """The differences of grey scan lines from what a filter type (0 to 4) expects; above: the line before the first."""
    if filter_type == 0:
        return pixels
    up = np.zeros_like(pixels)
    up[1:] = pixels[:-1]
    if above is not None and len(up):
        up[0] = above
    if filter_type == 2:
        return pixels - up
    left = np.zeros_like(pixels)
    left[:, 1:] = pixels[:, :-1]
    if filter_type == 1:
        return pixels - left
    a, b = left.astype(np.int16), up.astype(np.int16)
    if filter_type == 3:
        return pixels - ((a + b) >> 1).astype(np.uint8)
    if filter_type != 4:
        raise ValueError(f"unknown filter type {filter_type}")
    c = np.zeros_like(a)
    c[:, 1:] = b[:, :-1]
    return pixels - _paeth(a, b, c).astype(np.uint8)


def _paeth(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of left, above and the corner the one nearest to left + above - corner, the first of equal ones."""
    pa, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
    return np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c))


def filtered(pixels: np.ndarray, filter_type: int | None, above: np.ndarray | None = None) -> np.ndarray:
    """Scan lines with their filter type before each; None: for each line the one of the five whose differences, as
    signed bytes, have the least absolute sum (the first of equal ones)."""
    rows = np.empty((pixels.shape[0], pixels.shape[1] + 1), np.uint8)
    if filter_type is None:
        all_of = np.stack([filter_lines(pixels, k, above) for k in range(5)])
        rows[:, 0] = np.argmin(np.minimum(all_of, -all_of).sum(axis=2, dtype=np.int64), axis=0)
        rows[:, 1:] = all_of[rows[:, 0], np.arange(len(rows))]
    else:
        rows[:, 0] = filter_type
        rows[:, 1:] = filter_lines(pixels, filter_type, above)
    return rows


def png_encode(pixels: np.ndarray, filter_type: int | None = None, level: int = 3, piece: int = 1 << 20, band: int = 2048) -> bytes:
    """A grey 8-bit image (rows x columns) as PNG; filter_type as in filtered(). Lines are filtered `band` at a time."""
    height, width = pixels.shape
    deflate, packed = zlib.compressobj(level), []
    for at in range(0, height, band):
        rows = filtered(pixels[at : at + band], filter_type, pixels[at - 1] if at else None)
        packed.append(deflate.compress(rows.tobytes()))
    packed = b"".join([*packed, deflate.flush()])
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    body = b"".join(chunk(b"IDAT", packed[i : i + piece]) for i in range(0, len(packed), piece))
    return SIGNATURE + chunk(b"IHDR", head) + body + chunk(b"IEND", b"")


def png_chunks(data: bytes):
    """(kind, bytes) of each chunk up to IEND; ValueError for a broken file."""
    if data[:8] != SIGNATURE:
        raise ValueError("not a PNG file")
    at = 8
    while at + 12 <= len(data):
        (length,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + length]
        if len(body) < length or data[at + 8 + length : at + 12 + length] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ValueError(f"chunk {kind!r}: wrong checksum")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + length
    raise ValueError("the file ends before IEND")


def unfilter(images: list[np.ndarray], band: int = 512, most: int = 16 << 20) -> list[np.ndarray]:
    """Undo the filters of grey images' scan lines (the first column has the types), many images at a time.

    A pixel rests on those left of it, above it and at their corner. So all lines go at once, each one pixel behind the
    line above it: one step handles a pixel of every line. An image's lines go `band` at a time, and about `most` bytes together.
    """
    out = [np.empty((len(rows), rows.shape[1] - 1), np.uint8) for rows in images]
    by_width: dict[int, list[int]] = {}
    for i, rows in enumerate(images):
        by_width.setdefault(rows.shape[1] - 1, []).append(i)
    for width, members in by_width.items():
        at = 0
        while members:
            group, lanes = [], 0
            todo, members = members, []
            for i in todo:
                rows = images[i][at : at + band]
                if lanes and (lanes + len(rows)) * (width + band) > most:
                    _undo_wave(group, images, out, at, band, width)
                    group, lanes = [], 0
                group.append(i)
                lanes += len(rows) + 1
                if at + band < len(images[i]):
                    members.append(i)
            _undo_wave(group, images, out, at, band, width)
            at += band
    return out


def _undo_wave(group: list[int], images: list[np.ndarray], out: list[np.ndarray], at: int, band: int, width: int) -> None:
    """One band of some images of one width; the line above each band goes first, as it is."""
    lines, kinds, behind = [], [], []
    for i in group:
        rows = images[i][at : at + band]
        lines += [out[i][at - 1 : at] if at else np.zeros((1, width), np.uint8), rows[:, 1:]]
        kinds += [np.zeros(1, np.uint8), rows[:, 0]]
        behind.append(np.arange(len(rows) + 1))
    raw, kind, behind = np.concatenate(lines), np.concatenate(kinds), np.concatenate(behind)
    if kind.max(initial=0) > 4:
        raise ValueError(f"unknown filter type {kind.max()}")
    n, steps = len(raw), width + int(behind.max())
    lanes = np.arange(n)[None, :]
    times = np.arange(width)[:, None] + behind[None, :]
    skew = np.zeros((steps, n), np.uint8)
    skew[times, lanes] = raw.T
    sub, up, average, paeth = (np.where(kind == k, np.int16(1), np.int16(0)) for k in (1, 2, 3, 4))
    some_paeth = bool(paeth.any())
    # a place before the first line, so that what stands left and above are two views
    before, last = np.zeros(n + 1, np.int16), np.zeros(n + 1, np.int16)
    for t in range(steps):
        a, b = last[1:], last[:-1]
        guess = sub * a + up * b + average * ((a + b) >> 1)
        if some_paeth:
            guess += paeth * _paeth(a, b, before[:-1])
        now = np.empty(n + 1, np.int16)
        now[0] = 0
        np.bitwise_and(skew[t] + guess, 255, out=now[1:])
        skew[t] = now[1:]
        before, last = last, now
    whole = skew[times, lanes].T
    start = 0
    for i in group:
        count = min(band, len(images[i]) - at)
        out[i][at : at + count] = whole[start + 1 : start + 1 + count]
        start += count + 1


def png_rows(data: bytes) -> tuple[np.ndarray, int]:
    """The filtered scan lines of an 8-bit PNG without interlacing, with their types, and the bytes of a pixel."""
    head, packed = None, []
    for kind, body in png_chunks(data):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or head[6]:
        raise ValueError("only 8-bit images with direct samples and no interlacing are read")
    width, height, step = head[0], head[1], CHANNELS[head[3]]
    raw = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    if len(raw) != height * (width * step + 1):
        raise ValueError("wrong number of samples")
    return raw.reshape(height, width * step + 1), step


def png_decode_all(files: Iterable[bytes], most: int = 8 << 20) -> Iterator[np.ndarray]:
    """The samples of PNG files (rows x columns, or x channels too), unfiltered about `most` bytes at a time."""
    waiting: list[tuple[np.ndarray, int]] = []
    held = 0

    def flush() -> Iterator[np.ndarray]:
        # a pixel's channels don't rest on each other: each is an image
        planes = [np.column_stack([rows[:, 0], rows[:, 1 + c :: step]]) if step > 1 else rows for rows, step in waiting for c in range(step)]
        done = iter(unfilter(planes))
        for _, step in waiting:
            yield next(done) if step == 1 else np.stack([next(done) for _ in range(step)], axis=2)
        waiting.clear()

    for file in files:
        waiting.append(png_rows(file))
        held += waiting[-1][0].size
        if held >= most:
            yield from flush()
            held = 0
    yield from flush()


def png_decode(data: bytes) -> np.ndarray:
    return next(png_decode_all([data]))


def _cosines(n: int, k: int) -> np.ndarray:
    return np.cos(np.pi * (2 * np.arange(n)[None, :] + 1) * np.arange(k)[:, None] / (2 * n))


_DCT = _cosines(32, 8)


def shrink(pixels: np.ndarray, size: int = 32) -> np.ndarray:
    """Means over a grid of size x size cells; a side shorter than that repeats its samples."""
    out = pixels.astype(np.float64) if pixels.ndim == 2 else pixels.mean(axis=2)
    for axis in (0, 1):
        n = out.shape[axis]
        cuts = np.arange(size) * n // size
        if n < size:
            out = np.take(out, cuts, axis=axis)
        else:
            counts = np.diff(np.append(cuts, n))
            out = np.add.reduceat(out, cuts, axis=axis) / (counts[:, None] if axis == 0 else counts)
    return out


def cosine_hash(pixels: np.ndarray) -> str:
    """16 hex digits: which of the 64 lowest frequencies lie above their median (the mean's own aside)."""
    low = np.round(_DCT @ shrink(pixels) @ _DCT.T, 6).ravel()
    bits = low > np.median(low[1:])
    return np.packbits(bits).tobytes().hex()


def pad(payload: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 up to a positive multiple of `unit`."""
    return payload + b"\xff" * (-len(payload) % unit if payload else unit)


def store_bytes(df: DataFrame, column: str = "text", to: str = "media", unit: int = UNIT, keep: list[str] | None = None) -> DataFrame:
    """Append n_bytes and the binary column `to`: the column's UTF-8 bytes as a PNG `unit` samples wide, a filter chosen for each line.

    Null is empty; an empty value becomes one line of 255. Equal values give equal files. Rows stay one to one.
    """

    def compute():
        def run(v):
            return [[len(t) for t in v[0]], [png_encode(np.frombuffer(pad(t, unit), np.uint8).reshape(-1, unit), None) for t in v[0]]]

        return run

    return with_results(df, [utf8(column)], f"n_bytes long, `{to}` binary", compute, keep)


def read_media(df: DataFrame, media: str = "media", keep: list[str] | None = None, tail: int = UNIT) -> DataFrame:
    """Read PNG files of a binary column back; append their payload's and their own digests and the feature.

    tail_crc32 is over the last `tail` samples. A null file gives null results; a broken one (a checksum,
    the filter types, the number of samples) stops the job with ValueError, so that no row goes silently.
    """

    def one(data: bytes, pixels: np.ndarray) -> tuple:
        payload = pixels.tobytes()
        return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-tail:]), len(data), hashlib.sha256(data).hexdigest(), cosine_hash(pixels)

    def run(v):
        files = [f for f in v[0] if f is not None]
        made = (one(f, pixels) for f, pixels in zip(files, png_decode_all(files), strict=True))
        return [list(c) for c in zip(*(next(made) if f is not None else (None,) * 6 for f in v[0]), strict=True)]

    return with_results(df, [df[f"`{media}`"]], READ, lambda: run, keep)
