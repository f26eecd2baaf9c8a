"""Pictures as arrays: size and orientation of files, decoding of PNG, blur, edges, bounds, smaller copies."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from foliant.functions.codecs import unpredict

PNG = b"\x89PNG\r\n\x1a\n"


def kind(raw: bytes) -> str | None:
    return "jpeg" if raw[:3] == b"\xff\xd8\xff" else "png" if raw[:8] == PNG else None


def segments(raw: bytes):
    """(marker, payload) of a JPEG file up to its pixels."""
    at = 2
    while at + 4 <= len(raw) and raw[at] == 0xFF:
        marker, size = raw[at + 1], int.from_bytes(raw[at + 2 : at + 4], "big")
        if marker == 0xDA:
            return
        yield marker, raw[at + 4 : at + 2 + size]
        at += 2 + size


def jpeg_info(raw: bytes) -> tuple[int, int, int, int] | None:
    """Width, height, components and EXIF orientation (1 if there is none)."""
    size, turned = None, 1
    for marker, body in segments(raw):
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC) and len(body) >= 6:
            size = int.from_bytes(body[3:5], "big"), int.from_bytes(body[1:3], "big"), body[5]
        elif marker == 0xE1 and body[:6] == b"Exif\0\0":
            turned = orientation(body[6:])
    return (*size, turned) if size else None


def orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if not order or len(tiff) < 8:
        return 1
    start = struct.unpack(order + "I", tiff[4:8])[0]
    if start + 2 > len(tiff):
        return 1
    for i in range(struct.unpack(order + "H", tiff[start : start + 2])[0]):
        entry = tiff[start + 2 + 12 * i : start + 14 + 12 * i]
        if len(entry) == 12 and struct.unpack(order + "H", entry[:2])[0] == 0x0112:
            value = struct.unpack(order + "H", entry[8:10])[0]
            return value if 1 <= value <= 8 else 1
    return 1


def placed(turned: int, x: float, y: float, w: float, h: float) -> tuple[float, ...]:
    """The matrix that draws a unit picture upright into a box, for each EXIF orientation."""
    return {
        1: (w, 0, 0, h, x, y), 2: (-w, 0, 0, h, x + w, y), 3: (-w, 0, 0, -h, x + w, y + h), 4: (w, 0, 0, -h, x, y + h),
        5: (0, -h, -w, 0, x + w, y + h), 6: (0, -h, w, 0, x, y + h), 7: (0, h, w, 0, x, y), 8: (0, h, -w, 0, x + w, y),
    }[turned]


def png_pixels(raw: bytes) -> np.ndarray | None:
    """Pixels (height, width, channels) of an 8-bit PNG that isn't interlaced; palettes are looked up; None for others."""
    at, data, header, palette = 8, b"", None, None
    while at + 8 <= len(raw):
        size, name = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if name == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            data += body
        at += 12 + size
    if not header or header[2] != 8 or header[6]:
        return None
    width, height, _, color = header[:4]
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    try:
        plain = unpredict(zlib.decompress(data), 15, channels, 8, width)
    except zlib.error:
        return None
    if plain is None or len(plain) != width * height * channels:
        return None
    pixels = np.frombuffer(plain, np.uint8).reshape(height, width, channels)
    return palette[pixels[:, :, 0]] if color == 3 and palette is not None else pixels


def content_bounds(rgba: np.ndarray) -> tuple[int, int, int, int] | None:
    """The box of what shows: opaque enough and darker than paper in any channel; None for an empty page."""
    rows, columns = np.nonzero((rgba[:, :, 3] > 16) & (rgba[:, :, :3] < 240).any(2))
    return (int(columns.min()), int(rows.min()), int(columns.max()) + 1, int(rows.max()) + 1) if len(rows) else None


def blurred(plane: np.ndarray) -> np.ndarray:
    """Five taps 1-4-6-4-1 along both axes, edges repeated."""
    taps = np.array([1, 4, 6, 4, 1], np.float32) / 16
    for axis in (0, 1):
        wide = np.pad(plane, [(2, 2) if a == axis else (0, 0) for a in (0, 1)], mode="edge")
        plane = sum(t * np.take(wide, range(i, i + plane.shape[axis]), axis) for i, t in enumerate(taps))
    return plane


def gradients(plane: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sobel slopes across and down."""
    p = np.pad(plane, 1, mode="edge")
    across = (p[:-2, 2:] + 2 * p[1:-1, 2:] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[1:-1, :-2] + p[2:, :-2])
    down = (p[2:, :-2] + 2 * p[2:, 1:-1] + p[2:, 2:]) - (p[:-2, :-2] + 2 * p[:-2, 1:-1] + p[:-2, 2:])
    return across, down


def shrunk(pixels: np.ndarray, width: int, height: int) -> np.ndarray:
    """Means of the cells that the pixels fall into, rounded down."""
    h, w = pixels.shape[:2]
    rows, columns = np.arange(height) * h // height, np.arange(width) * w // width
    sums = np.add.reduceat(np.add.reduceat(pixels.astype(np.int64), rows, 0), columns, 1)
    cells = np.outer(np.diff(np.append(rows, h)), np.diff(np.append(columns, w)))
    return (sums // (cells[:, :, None] if pixels.ndim == 3 else cells)).astype(pixels.dtype)


def fitted(width: int, height: int, most: int) -> tuple[int, int]:
    """Size with the longer side cut to ``most``, in proportion, at least one pixel."""
    side = max(width, height)
    return (width, height) if side <= most else (max(1, width * most // side), max(1, height * most // side))


def differing_cells(a: np.ndarray, b: np.ndarray, cell: int, least: int = 40) -> np.ndarray:
    """Cells in which any channel differs by more than ``least``, grown by one cell."""
    far = (np.abs(a.astype(int) - b.astype(int)) > least).any(2)
    rows, columns = -(-far.shape[0] // cell), -(-far.shape[1] // cell)
    grid = np.pad(far, [(0, rows * cell - far.shape[0]), (0, columns * cell - far.shape[1])]).reshape(rows, cell, columns, cell).any((1, 3))
    wide = np.pad(grid, 1)
    return np.any([wide[i : i + rows, j : j + columns] for i in range(3) for j in range(3)], axis=0)
