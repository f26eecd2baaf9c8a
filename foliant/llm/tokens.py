"""Words of many texts at once: their places in the bytes and their hashes, without a Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are read together up to so many bytes; a longer text goes by pieces that end at white space.
PIECE = 1 << 18
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: A hash is a polynomial in the values of its bytes, modulo 2^64.
VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
FACTOR = 0x9E3779B97F4A7C15


class Words(NamedTuple):
    """Words of the texts from number ``first`` on (or of a piece of it): how many each has, where they lie in ``raw``, hashes.

    The low byte of a hash is the word's last byte.
    """

    first: int
    counts: np.ndarray
    raw: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


@lru_cache(maxsize=4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for factor in (FACTOR, pow(FACTOR, -1, 1 << 64)):
        line = np.full(n, factor, np.uint64)
        line[0] = 1
        out.append(np.cumprod(line))
    return out[0], out[1]


def bytes_of(batch: pa.RecordBatch, name: str = "text", row: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column (or of that field of a column of rows) and the offsets of its texts; a null text is empty."""
    column = pc.struct_field(batch.column(row), name) if row else batch.column(name)
    column = column.fill_null("").cast(pa.large_binary())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return raw, offsets - offsets[0]


def words_of(first: int, raw: np.ndarray, cuts: np.ndarray) -> Words:
    """Words of the texts between ``cuts``, which begin at 0 and end with ``raw``."""
    if not len(raw):
        none = np.empty(0, np.int64)
        return Words(first, np.zeros(len(cuts) - 1, np.int64), raw, none, none, none.view(np.uint64))
    inside = ~SPACES[raw]
    opens, closes = inside.copy(), inside.copy()
    opens[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edges = cuts[(cuts > 0) & (cuts < len(raw))]
    opens[edges] = inside[edges]
    closes[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    size = 1 << max(18, (len(raw) - 1).bit_length())
    up, down = powers(size)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(VALUES[raw] * up[: len(raw)], out=total[1:])
    hashes = (total[ends] - total[starts]) * down[starts]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    hashes = (hashes & np.uint64(0xFFFFFFFFFFFFFF00)) | raw[ends - 1]
    return Words(first, np.diff(np.searchsorted(starts, cuts)), raw, starts, ends, hashes)


def split(raw: np.ndarray, offsets: np.ndarray, piece: int = PIECE) -> Iterator[Words]:
    """The words of all texts, in order; each call's memory is bounded by ``piece``, or by the longest word."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + piece, side="right")) - 1
        if j > i:
            yield words_of(i, raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            i = j
            continue
        at, end = int(offsets[i]), int(offsets[i + 1])
        while at < end:
            to = min(end, at + piece)
            if to < end:
                gaps = np.flatnonzero(SPACES[raw[at:to]])
                if not len(gaps):
                    ahead = ((s, SPACES[raw[s : min(end, s + piece)]]) for s in range(to, end, piece))
                    to = next((s + int(np.argmax(gap)) for s, gap in ahead if gap.any()), end)
                else:
                    to = at + int(gaps[-1]) + 1
            yield words_of(i, raw[at:to], np.array([0, to - at]))
            at = to
        i += 1
