"""Filters of PDF streams and what decides between two encodings."""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from foliant.sources.pdf import inflate


def rc4(key: bytes, data: bytes) -> bytes:
    state = list(range(256))
    j = 0
    for i in range(256):
        j = (j + state[i] + key[i % len(key)]) & 255
        state[i], state[j] = state[j], state[i]
    out, i, j = bytearray(), 0, 0
    for byte in data:
        i = (i + 1) & 255
        j = (j + state[i]) & 255
        state[i], state[j] = state[j], state[i]
        out.append(byte ^ state[(state[i] + state[j]) & 255])
    return bytes(out)


def run_length(data: bytes) -> bytes | None:
    """Lengths under 128 copy the next bytes, over it repeat the next one, 128 ends; None if the data ends early."""
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        piece = data[at + 1 : at + 2 + n] if n < 128 else data[at + 1 : at + 2] * (257 - n)
        if len(piece) != (n + 1 if n < 128 else 257 - n):
            return None
        out += piece
        at += n + 2 if n < 128 else 2
    return bytes(out)


def hex_decode(data: bytes) -> bytes | None:
    digits = bytes(c for c in data.split(b">")[0] if c not in b" \t\r\n\f\0")
    try:
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))
    except ValueError:
        return None


def unpredict(data: bytes, predictor: int, colors: int = 1, bits: int = 8, columns: int = 1) -> bytes | None:
    """Undoes the TIFF predictor (2, for 8 bits) and the row filters of PNG (10 and up)."""
    step, width = max(1, colors * bits // 8), (colors * bits * columns + 7) // 8
    if predictor < 2:
        return data
    if predictor == 2:
        if bits != 8 or len(data) % width:
            return None
        rows = np.frombuffer(data, np.uint8).reshape(-1, columns, colors)
        return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()
    out, above = bytearray(), bytes(width)
    for start in range(0, len(data), width + 1):
        kind, raw = data[start], data[start + 1 : start + 1 + width]
        if kind > 4 or len(raw) < width:
            return None
        row = bytearray(width)
        for i, x in enumerate(raw):
            left = row[i - step] if i >= step else 0
            up, corner = above[i], above[i - step] if i >= step else 0
            guess = (0, left, up, (left + up) // 2, paeth(left, up, corner))[kind]
            row[i] = (x + guess) & 255
        out += row
        above = bytes(row)
    return bytes(out)


def paeth(left: int, up: int, corner: int) -> int:
    p = left + up - corner
    return min((abs(p - left), 0, left), (abs(p - up), 1, up), (abs(p - corner), 2, corner))[2]


@F.pandas_udf(BinaryType())
def inflated(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else inflate(bytes(d)))


@F.pandas_udf(BinaryType())
def deflated(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else zlib.compress(bytes(d), 9))


def smaller(a: Column, b: Column) -> Column:
    """The first of two encodings unless the second is smaller."""
    return F.when(F.length(b) < F.length(a), b).otherwise(a)


def packed(data: Column, least: int = 64) -> Column:
    """A stream deflated anew if it is long enough and that is smaller."""
    return F.when(F.length(data) >= least, smaller(data, deflated(data))).otherwise(data)


@F.pandas_udf(BinaryType())
def run_length_read(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else run_length(bytes(d)))


@F.pandas_udf(BinaryType())
def hex_read(data: pd.Series) -> pd.Series:
    return data.map(lambda d: None if d is None else hex_decode(bytes(d)))


@F.pandas_udf(BinaryType())
def rc4_applied(key: pd.Series, data: pd.Series) -> pd.Series:
    """RC4 with a key of its own for each row; applied twice, the data again."""
    return pd.Series([None if d is None else rc4(bytes(k), bytes(d)) for k, d in zip(key, data, strict=True)])


@F.pandas_udf(BinaryType())
def rows_unfiltered(data: pd.Series, columns: pd.Series) -> pd.Series:
    """PNG rows of ``columns`` bytes without their filters."""
    return pd.Series([None if d is None else unpredict(bytes(d), 15, 1, 8, int(c)) for d, c in zip(data, columns, strict=True)])
