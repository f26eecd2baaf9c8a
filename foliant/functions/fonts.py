"""Codes and characters of fonts: encodings, maps between codes and text, what a font lacks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

#: Characters of the Windows-1252 encoding beyond Latin-1, by rule from the codec.
WIN_ANSI = {c: i for i in range(32, 256) if (c := bytes([i]).decode("cp1252", "ignore"))}
MOST = 1 << 20


def win_ansi(character: str) -> int | None:
    return WIN_ANSI.get(character)


def needs_embedding(text: Column) -> Column:
    """Whether any character is outside of the standard fonts' encoding."""
    extra = "".join(c for c in WIN_ANSI if ord(c) > 255)
    return text.rlike("[^\\x20-\\x7e\\u00a0-\\u00ff\\n\\r\\t" + extra + "]")


def missing(text: Column, covered: Column) -> Column:
    """Characters of a text that a font doesn't have, each once, in order; blanks aside."""
    return F.array_join(F.filter(F.array_except(F.split(text, ""), covered), lambda c: F.trim(c) != ""), "")


def east_asian_faces(text: Column, language: Column) -> Column:
    """Which faces text in Chinese, Japanese or Korean needs: by its scripts, else by the reader's language, else the simplified one."""
    kana, hangul, han = text.rlike(r"[\p{IsHiragana}\p{IsKatakana}]"), text.rlike(r"\p{IsHangul}"), text.rlike(r"\p{IsHan}")
    tag = F.lower(language)
    read = F.when(tag.startswith("ja"), "japanese").when(tag.startswith("ko"), "korean").when(tag.rlike("^zh-(tw|hk|mo|hant)"), "traditional").otherwise("simplified")
    own = F.array_compact(F.array(F.when(kana, F.lit("japanese")), F.when(hangul, F.lit("korean"))))
    return F.when(F.size(own) > 0, own).when(han, F.array(read)).otherwise(F.array().cast("array<string>"))


def first_uncovered(text: Column, covers: list[str]) -> Column:
    """The first character outside of the standard encoding that none of the patterns covers; null if there is none."""
    extra = "".join(c for c in WIN_ANSI if ord(c) > 255)
    known = "[\\x20-\\x7e\\u00a0-\\u00ff\n\r" + extra + "]"
    letters = F.filter(F.split(text, ""), lambda c: (c != "") & ~c.rlike("|".join([known, *covers])))
    return F.try_element_at(letters, F.lit(1))


def hexes(raw: str) -> list[bytes]:
    return [bytes.fromhex(h.replace(" ", "")) for h in re.findall(r"<([0-9A-Fa-f\s]*)>", raw)]


def number(b: bytes) -> int:
    return int.from_bytes(b, "big")


def sections(cmap: str, name: str) -> list[str]:
    return re.findall(rf"begin{name}(.*?)end{name}", cmap, re.S)


def code_spaces(cmap: str) -> list[tuple[int, int, int]]:
    """(bytes, first, last) of each code space."""
    out = []
    for part in sections(cmap, "codespacerange"):
        h = hexes(part)
        out += [(len(a), number(a), number(b)) for a, b in zip(h[::2], h[1::2], strict=False)]
    return out


def in_space(code: bytes, space: tuple[int, int, int]) -> bool:
    n, low, high = space
    lows, highs = low.to_bytes(n, "big"), high.to_bytes(n, "big")
    return len(code) == n and all(a <= c <= b for a, c, b in zip(lows, code, highs, strict=True))


def code_length(spaces: list[tuple[int, int, int]], data: bytes) -> int:
    """Bytes of the next code: the shortest that a space holds, else of the first space that its first byte fits (as far as there are bytes), else one."""
    held = [n for n in range(1, min(4, len(data)) + 1) if any(in_space(data[:n], s) for s in spaces)]
    near = [n for n, low, high in spaces if data and low.to_bytes(n, "big")[0] <= data[0] <= high.to_bytes(n, "big")[0]]
    return max(1, min((held or near or [1])[0], len(data)))


def to_unicode(cmap: str) -> dict[tuple[int, int], str]:
    """Text by (bytes, code), from single codes, ranges that count up and ranges with a list; of so many entries at most."""
    out: dict[tuple[int, int], str] = {}
    for part in sections(cmap, "bfchar"):
        h = hexes(part)
        for code, text in zip(h[::2], h[1::2], strict=False):
            out[len(code), number(code)] = text.decode("utf-16-be", "replace")
    for part in sections(cmap, "bfrange"):
        for a, b, one, several in re.findall(r"<([0-9A-Fa-f\s]+)>\s*<([0-9A-Fa-f\s]+)>\s*(?:<([0-9A-Fa-f\s]*)>|\[(.*?)\])", part, re.S):
            first, last = hexes(f"<{a}>")[0], hexes(f"<{b}>")[0]
            texts = hexes(several)
            for i in range(min(number(last) - number(first) + 1, MOST - len(out))):
                if several:
                    if i >= len(texts):
                        break
                    value = texts[i]
                else:
                    base = hexes(f"<{one}>")[0]
                    value = base[:-1] + bytes([(base[-1] + i) & 255]) if len(base) > 2 else ((number(base) + i) & 0xFFFF).to_bytes(2, "big")
                out[len(first), number(first) + i] = value.decode("utf-16-be", "replace")
    return out


def write_to_unicode(used: dict[int, str]) -> str:
    """A map from two-byte codes to text, in blocks of a hundred."""
    rows = [f"<{code:04X}> <{text.encode('utf-16-be').hex().upper()}>" for code, text in sorted(used.items())]
    blocks = [f"{len(b)} beginbfchar\n" + "\n".join(b) + "\nendbfchar" for b in (rows[i : i + 100] for i in range(0, len(rows), 100))]
    return "1 begincodespacerange\n<0000> <FFFF>\nendcodespacerange\n" + "\n".join(blocks)


def widths(entries: list) -> dict[int, float]:
    """Widths by character from ``c [w ...]`` and ``first last w`` entries."""
    out: dict[int, float] = {}
    at = 0
    while at + 1 < len(entries):
        first, second = entries[at], entries[at + 1]
        if isinstance(second, list):
            out |= {first + i: w for i, w in enumerate(second)}
            at += 2
        elif at + 2 < len(entries):
            out |= dict.fromkeys(range(first, min(second, first + MOST - len(out) - 1) + 1), entries[at + 2])
            at += 3
        else:
            break
    return out


def glyph_text(name: str) -> str | None:
    """Text of a glyph's name: uniXXXX and uXXXX forms, letters, and names of digits; parts by underscores, endings after a point left out."""
    names = {n: str(i) for i, n in enumerate("zero one two three four five six seven eight nine".split())} | {"space": " ", "hyphen": "-", "period": ".", "comma": ","}
    out = ""
    for part in name.split(".")[0].split("_"):
        if m := re.fullmatch(r"uni((?:[0-9A-F]{4})+)", part):
            out += bytes.fromhex(m[1]).decode("utf-16-be", "replace")
        elif m := re.fullmatch(r"u([0-9A-F]{4,6})", part):
            out += chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else ""
        elif len(part) == 1:
            out += part
        elif part in names:
            out += names[part]
        else:
            return None
    return out or None


@F.pandas_udf(ArrayType(IntegerType()))
def win_ansi_codes(text: pd.Series) -> pd.Series:
    """The standard encoding's code of each character; null for characters without one."""
    return text.map(lambda t: None if t is None else [WIN_ANSI.get(c) for c in t])


@F.pandas_udf(StringType())
def glyph_texts(name: pd.Series) -> pd.Series:
    return name.map(lambda n: None if n is None else glyph_text(n))


@F.pandas_udf(StringType())
def unicode_map(characters: pd.Series) -> pd.Series:
    """A map from the codes 0, 1, 2 ... to the characters of a text."""
    return characters.map(lambda t: None if t is None else write_to_unicode(dict(enumerate(t))))


@F.pandas_udf(StringType())
def mapped_text(cmap: pd.Series) -> pd.Series:
    """The text of all two-byte codes of a map, in order."""
    return cmap.map(lambda m: None if m is None else "".join(t for _, t in sorted(to_unicode(m).items())))
