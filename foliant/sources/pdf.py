"""PDF files as tables: a small reader and writer of classic files, in plain Python inside Arrow and pandas stages.

It reads objects by their ``n g obj`` marks and from object streams, Flate streams, inherited page attributes, and text in simple and
composite fonts with their widths and maps to Unicode, placed by text and page matrices. Damaged files become a row with a status, never a
lost row. Encryption, images and rendering are outside; such files are told by their status.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from foliant.functions.fonts import to_unicode, widths

OBJECT = re.compile(rb"(?<![0-9])(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj\b", re.S)
STREAM = re.compile(rb"^(.*?)\bstream\r?\n(.*?)\r?\n?endstream", re.S)
REFERENCE = re.compile(rb"(\d+)\s+\d+\s+R\b")
LARGEST = 256 << 20
#: Bytes and rows that leave a Python stage at once.
AT_ONCE, MOST_ROWS = 16 << 20, 1 << 14


def inflate(data: bytes, most: int = LARGEST) -> bytes | None:
    """A Flate stream's bytes; None if it is damaged, empty or longer than ``most``."""
    try:
        engine = zlib.decompressobj()
        out = engine.decompress(data, most)
    except zlib.error:
        return None
    return out if out and not engine.unconsumed_tail else None


def stream_parts(body: bytes) -> tuple[bytes, bytes, bool] | None:
    """Dictionary text and raw bytes of an object's stream, and whether its length told where they end; None for an object without a stream."""
    opens = re.search(rb"\bstream\r?\n", body)
    if not opens:
        return None
    head, start = body[: opens.start()], opens.end()
    length = value(head, "Length")
    if length and not references(length):
        end = start + int((numbers(length) or [0])[0])
        if re.match(rb"\s*endstream", body[end : end + 16]):
            return head, body[start:end], True
    found = STREAM.search(body)
    return (found[1], found[2], False) if found else None


def objects(raw: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Dictionary text and stream bytes (decoded where Flate) by object number; a later object with a number replaces an earlier one.

    Objects packed in streams count where no object of their number stands by itself.
    """
    out = {}
    for m in OBJECT.finditer(raw):
        parts = stream_parts(m[3])
        if parts:
            head, data, _ = parts
            if b"/FlateDecode" in head:
                data = inflate(data)
            out[int(m[1])] = (head.strip(), data if data is not None else b"")
        else:
            out[int(m[1])] = (m[3].strip(), None)
    for head, data in list(out.values()):
        if data and value(head, "Type") == b"/ObjStm":
            n, first = (int((numbers(value(head, k)) or [0])[0]) for k in ("N", "First"))
            table = [int(x) for x in numbers(data[:first])][: 2 * n]
            ends = [*table[3::2], len(data) - first]
            for number, start, end in zip(table[::2], table[1::2], ends, strict=False):
                out.setdefault(number, (data[first + start : first + end].strip(), None))
    return out


def losses(raw: bytes) -> str | None:
    """Why a file's objects can't all be read as its author wrote them: the first of the table's objects that is missing, a stream without a length or with a wrong one."""
    found = objects(raw)
    for start, lines in re.findall(rb"(\d+)\s+\d+\s*\r?\n((?:\d{10} \d{5} [nf]\s*)+)", raw):
        for i, line in enumerate(re.findall(rb"\d{10} \d{5} ([nf])", lines)):
            if line == b"n" and int(start) + i not in found:
                return f"object {int(start) + i} is missing"
    for m in OBJECT.finditer(raw):
        parts = stream_parts(m[3])
        if parts:
            head, data, exact = parts
            length = value(head, "Length")
            if length is None:
                return f"stream {int(m[1])} has no length"
            below = references(length)
            if not exact and not (below and numbers(found.get(below[0], (b"", None))[0])[:1] == [len(data)]):
                return f"stream {int(m[1])} has a wrong length"
    return None


def value(head: bytes, name: str) -> bytes | None:
    """The raw value of a key: an array, a reference, a dictionary or a plain word."""
    m = re.search(rb"/" + name.encode() + rb"(?![A-Za-z0-9])\s*(\[[^\]]*\]|\d+\s+\d+\s+R|<<.*?>>|/?[^\s/<>\[\]]+)", head, re.S)
    return m[1] if m else None


def numbers(raw: bytes | None) -> list[float]:
    return [float(x) for x in re.findall(rb"[-+]?\d*\.?\d+", raw or b"")]


def references(raw: bytes | None) -> list[int]:
    return [int(x) for x in REFERENCE.findall(raw or b"")]


def page_rows(raw: bytes) -> tuple[str, list[dict]]:
    """(status, pages in the order of the page tree) of a file; status is readable, locked or damaged."""
    if not raw or b"%PDF-" not in raw[:1024]:
        return "damaged", []
    if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", raw):
        return "locked", []
    found = objects(raw)
    root = re.search(rb"/Root\s+(\d+)\s+\d+\s+R", raw)
    catalog = found.get(int(root[1]) if root else -1, (b"", None))[0]
    start = references(value(catalog, "Pages"))
    pages, waiting, seen = [], [(n, {}) for n in start], set()
    while waiting:
        number, above = waiting.pop(0)
        if number in seen or number not in found:
            return "damaged", []
        seen.add(number)
        head = found[number][0]
        own = above | {k: v for k in ("MediaBox", "CropBox", "Rotate", "Resources") if (v := value(head, k))}
        kids = references(value(head, "Kids"))
        if kids:
            waiting = [(k, own) for k in kids] + waiting
        elif value(head, "Type") == b"/Page":
            box = numbers(own.get("CropBox") or own.get("MediaBox")) or [0.0, 0.0, 612.0, 792.0]
            parts = [found.get(n, (b"", b""))[1] or b"" for n in references(value(head, "Contents"))]
            turned = int((numbers(own.get("Rotate")) or [0])[0]) % 360
            pages.append({"page_no": len(pages) + 1, "width": box[2] - box[0], "height": box[3] - box[1], "rotate": turned, "content": b"\n".join(parts), "fonts": json.dumps(page_fonts(found, own.get("Resources", b"")))})
    return ("readable", pages) if pages else ("damaged", [])


TOKEN = re.compile(rb"\((?:[^()\\]++|\\.)*+\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|[-+]?\d*\.?\d+|[A-Za-z'\"*]+[0-9*]?|\S", re.S)
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def raw_string(token: bytes) -> bytes:
    """The bytes of a string in hex or in parentheses."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    if b"\\" not in token:
        return token[1:-1]
    return re.sub(rb"\\(\r\n|[0-7]{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() and m[1][:1] in b"01234567" else ESCAPES.get(m[1], b"" if m[1] in (b"\r\n", b"\n", b"\r") else m[1]), token[1:-1], flags=re.S)


def resolved(found: dict, raw: bytes | None) -> bytes:
    """A value, or what it refers to."""
    if raw and re.fullmatch(rb"\d+\s+\d+\s+R", raw.strip()):
        return found.get(references(raw)[0], (b"", None))[0]
    return raw or b""


def dictionary(found: dict, head: bytes, name: str) -> bytes:
    """The text of a dictionary under a key, whether it stands there or is referred to; brackets are counted."""
    m = re.search(rb"/" + name.encode() + rb"(?![A-Za-z0-9])\s*(<<|\d+\s+\d+\s+R)", head)
    if not m:
        return b""
    if m[1] != b"<<":
        return resolved(found, m[1])
    depth = 0
    for mark in re.finditer(rb"<<|>>", head[m.start(1) :]):
        depth += 1 if mark[0] == b"<<" else -1
        if not depth:
            return head[m.start(1) : m.start(1) + mark.end()]
    return head[m.start(1) :]


def page_fonts(found: dict, resources: bytes) -> dict[str, dict]:
    """What text needs to know of each font of a page: bytes of a code, widths in thousandths by code, the width of others, characters by code."""
    out = {}
    for name, number in re.findall(rb"/([^\s/<>\[\]]+)\s+(\d+)\s+\d+\s+R", dictionary(found, resolved(found, resources), "Font")):
        head = found.get(int(number), (b"", None))[0]
        two = value(head, "Subtype") == b"/Type0"
        known: dict[int, float] = {}
        default = 1000.0 if two else 500.0
        if two:
            below = found.get((references(value(head, "DescendantFonts")) or [-1])[0], (b"", None))[0]
            default = (numbers(value(below, "DW")) or [1000.0])[0]
            held = re.search(rb"/W\s*\[(.*)\]", below, re.S)
            whole = lambda x: int(x) if x == int(x) else x
            parts = re.findall(rb"\[[^\]]*\]|[-+]?\d*\.?\d+", held[1]) if held else []
            known = widths([numbers(e) if e[:1] == b"[" else whole(float(e)) for e in parts])
        else:
            first = int((numbers(value(head, "FirstChar")) or [0])[0])
            known = {first + i: w for i, w in enumerate(numbers(resolved(found, value(head, "Widths"))))}
            if value(head, "BaseFont") and b"Courier" in value(head, "BaseFont"):
                default = 600.0
        cmap = found.get((references(value(head, "ToUnicode")) or [-1])[0], (b"", None))[1]
        text = {code: t for (_, code), t in to_unicode(cmap.decode("latin-1")).items()} if cmap else {}
        out[name.decode("latin-1")] = {"two": two, "widths": known, "default": default, "text": text}
    return out


Matrix = tuple[float, float, float, float, float, float]


def times(a: Matrix, b: Matrix) -> Matrix:
    return (
        a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3],
        a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5],
    )


ONE: Matrix = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


class Run(NamedTuple):
    """The characters of one string: their texts, and their boxes as arrays."""

    texts: list[str]
    l: np.ndarray
    b: np.ndarray
    r: np.ndarray
    t: np.ndarray
    size: float
    invisible: bool


class Pen:
    """Where text is drawn: the page's matrix with its stack, the line's and the text's matrix, the font and its spacing."""

    def __init__(self, fonts: dict[str, dict]) -> None:
        self.fonts, self.font = fonts, {}
        self.page, self.stack, self.line, self.at = ONE, [], ONE, ONE
        self.size, self.leading, self.between, self.words, self.wide, self.rise, self.mode = 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0
        self.out: list[Run] = []

    def move(self, x: float, y: float) -> None:
        self.line = self.at = times((1, 0, 0, 1, x, y), self.line)

    def codes(self, raw: bytes) -> list[int]:
        return [raw[i] << 8 | raw[i + 1] for i in range(0, len(raw) - 1, 2)] if self.font.get("two") else list(raw)

    def texts(self, raw: bytes) -> list[str]:
        known = self.font.get("text", {})
        if self.font.get("two"):
            return [known.get(str(c), known.get(c, "\ufffd")) for c in self.codes(raw)]
        plain = list(raw.decode("cp1252", "replace"))
        return [known.get(str(c), known.get(c, p)) for c, p in zip(raw, plain, strict=True)] if known else plain

    def show(self, raw: bytes) -> None:
        """Boxes of a string at once: its characters differ by how far the pen has come, along one direction."""
        texts = self.texts(raw)
        if not texts:
            return
        known, default = self.font.get("widths", {}), self.font.get("default", 500.0)
        codes = self.codes(raw)
        width = (np.array([known.get(str(c), known.get(c, default)) for c in codes], float) if known else np.full(len(codes), float(default))) / 1000
        blank = np.zeros(len(codes)) if self.font.get("two") or not self.words else np.array(codes) == 32
        upto = np.concatenate([[0.0], np.cumsum((width * self.size + self.between + self.words * blank) * self.wide)])
        m = times(times((self.size * self.wide, 0, 0, self.size, 0, self.rise), self.at), self.page)
        along = times((*self.at[:4], 0, 0), self.page)
        x, y = m[4] + upto[:-1] * along[0], m[5] + upto[:-1] * along[1]
        dx, dy = width * m[0], width * m[1]
        low, high = (lambda a, d, up: a + np.minimum(d, 0) + min(up, 0)), (lambda a, d, up: a + np.maximum(d, 0) + max(up, 0))
        self.out.append(Run(texts, low(x, dx, m[2]), low(y, dy, m[3]), high(x, dx, m[2]), high(y, dy, m[3]), (m[2] ** 2 + m[3] ** 2) ** 0.5, self.mode == 3))
        self.at = times((1, 0, 0, 1, float(upto[-1]), 0), self.at)

    def back(self, thousandths: float) -> None:
        self.at = times((1, 0, 0, 1, -thousandths / 1000 * self.size * self.wide, 0), self.at)

    def run(self, op: bytes, operands: list[bytes], nums: list[float]) -> None:
        if op == b"BT":
            self.line = self.at = ONE
        elif op == b"q":
            self.stack.append((self.page, self.font, self.size, self.leading, self.between, self.words, self.wide, self.rise, self.mode))
        elif op == b"Q" and self.stack:
            self.page, self.font, self.size, self.leading, self.between, self.words, self.wide, self.rise, self.mode = self.stack.pop()
        elif op == b"cm" and len(nums) == 6:
            self.page = times(tuple(nums), self.page)
        elif op == b"Tf" and nums:
            self.size = nums[-1]
            self.font = self.fonts.get(operands[0][1:].decode("latin-1"), {}) if operands[0][:1] == b"/" else {}
        elif op in (b"Td", b"TD") and len(nums) == 2:
            self.leading = -nums[1] if op == b"TD" else self.leading
            self.move(*nums)
        elif op == b"Tm" and len(nums) == 6:
            self.line = self.at = tuple(nums)
        elif op == b"T*":
            self.move(0, -self.leading)
        elif op in (b"'", b'"') and operands:
            if op == b'"' and len(nums) > 1:
                self.words, self.between = nums[:2]
            self.move(0, -self.leading)
            self.show(raw_string(operands[-1]))
        elif op == b"Tj" and operands:
            self.show(raw_string(operands[-1]))
        elif op == b"TJ":
            for t in operands:
                if t[:1] in b"(<":
                    self.show(raw_string(t))
                elif t not in (b"[", b"]"):
                    self.back(float(t))
        elif len(nums) == 1 and op in SETTINGS:
            setattr(self, SETTINGS[op], nums[0] / 100 if op == b"Tz" else int(nums[0]) if op == b"Tr" else nums[0])


SETTINGS = {b"TL": "leading", b"Tc": "between", b"Tw": "words", b"Tz": "wide", b"Ts": "rise", b"Tr": "mode"}
NUMBER = re.compile(rb"[-+]?\d*\.?\d+")


class Reader(Pen):
    """A pen that only notes what it draws, where nobody asks for places."""

    def __init__(self, fonts: dict[str, dict]) -> None:
        super().__init__(fonts)
        self.said: list[str] = []

    def show(self, raw: bytes) -> None:
        self.said += self.texts(raw) if self.font.get("text") or self.font.get("two") else [raw.decode("cp1252", "replace")]


def drawn_by(pen: Pen, content: bytes) -> Iterator[None]:
    """Runs the operators of a page, with a stop after each."""
    operands: list[bytes] = []
    for m in TOKEN.finditer(content):
        token = m[0]
        if token[:1] in b"(<[]/" or NUMBER.fullmatch(token):
            operands.append(token)
        else:
            pen.run(token, operands, [float(t) for t in operands if NUMBER.fullmatch(t)])
            operands = []
            yield


def runs(content: bytes, fonts: dict[str, dict] | None = None) -> Iterator[Run]:
    """The strings drawn on a page, in order."""
    pen = Pen(fonts or {})
    for _ in drawn_by(pen, content):
        yield from pen.out
        pen.out.clear()


def glyphs(content: bytes, fonts: dict[str, dict] | None = None) -> list[dict]:
    """Characters drawn on a page with the boxes of their advances in points, in order."""
    boxes = lambda r: zip(r.texts, r.l.tolist(), r.b.tolist(), r.r.tolist(), r.t.tolist(), strict=True)
    return [{"text": text, "l": x, "b": y, "r": right, "t": top, "size": r.size, "invisible": r.invisible} for r in runs(content, fonts) for text, x, y, right, top in boxes(r)]


def text_of(content: bytes, fonts: dict[str, dict] | None = None) -> str:
    """The characters drawn on a page, in order."""
    pen = Reader(fonts or {})
    for _ in drawn_by(pen, content):
        pass
    return "".join(pen.said)


#: The font that ``text_content`` draws with: every character is as wide as any other.
FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"


def write(pages: list[dict], packed_objects: bool = False) -> bytes:
    """A file of ``pages`` (width, height, rotate, content), with content in Flate streams and equal streams stored once; on demand, objects packed in a stream."""
    bodies: list[bytes] = [b"", b"", FONT]
    stored: dict[bytes, int] = {}
    kids = []
    for p in pages:
        if p["content"] not in stored:
            packed = zlib.compress(p["content"], 9)
            bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed))
            stored[p["content"]] = len(bodies)
        bodies.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %g %g] /Rotate %d /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (p["width"], p["height"], p["rotate"], stored[p["content"]]))
        kids.append(len(bodies))
    bodies[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    bodies[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, places = b"%PDF-1.5\n%\xe2\xe3\xcf\xd3\n", []
    if packed_objects:
        plain = [(i, b) for i, b in enumerate(bodies, 1) if b"\nstream\n" not in b]
        starts, at = [], 0
        for i, b in plain:
            starts.append(b"%d %d" % (i, at))
            at += len(b) + 1
        table = b" ".join(starts) + b" "
        held = zlib.compress(table + b"\n".join(b for _, b in plain), 9)
        n = len(bodies) + 1
        rows = [(i, b) for i, b in enumerate(bodies, 1) if b"\nstream\n" in b]
        rows.append((n, b"<< /Type /ObjStm /N %d /First %d /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(plain), len(table), len(held), held)))
        for i, body in rows:
            out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
        index = zlib.compress(b"")
        return out + b"%d 0 obj\n<< /Type /XRef /Size %d /Root 1 0 R /W [1 4 2] /Index [0 0] /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF\n" % (n + 1, n + 2, len(index), index, len(out))
    for i, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i, body)
    table = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n%strailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, table, len(bodies) + 1, len(out))


def text_content(text: str, size: float = 12.0, left: float = 72.0, top: float = 720.0) -> bytes:
    """A page's content that draws lines of text."""
    raw = re.sub(rb"([()\\])", rb"\\\1", text.encode("cp1252", "replace"))
    head = b"BT /F1 %g Tf %g TL %g %g Td" % (size, size * 1.2, left, top)
    return b"\n".join([head, b"(" + raw.replace(b"\n", b") Tj T*\n(") + b") Tj T*", b"ET"])


@F.pandas_udf(BinaryType())
def drawn(text: pd.Series) -> pd.Series:
    """The content of a page that draws each text."""
    return text.map(lambda t: text_content(t or ""))


PAGE = pa.schema([("path", pa.string()), ("status", pa.string()), ("page_no", pa.int32()), ("width", pa.float64()), ("height", pa.float64()), ("rotate", pa.int32()), ("content", pa.binary()), ("fonts", pa.string())])


def read_pages(files: DataFrame) -> DataFrame:
    """``path, status, page_no, width, height, rotate, content, fonts`` for ``files`` (path, content) as ``binaryFile`` gives them; an unreadable file has one row without a page."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for part in parts:
            for path, raw in zip(part.column("path"), part.column("content"), strict=True):
                status, pages = page_rows(raw.as_py() or b"")
                rows += [p | {"path": path.as_py(), "status": status} for p in pages or [{}]]
                held += sum(len(p["content"]) for p in pages)
                if held > AT_ONCE or len(rows) > MOST_ROWS:
                    yield pa.RecordBatch.from_pylist(rows, PAGE)
                    rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, PAGE)

    return files.select(F.col("path").cast("string"), F.col("content").cast("binary")).mapInArrow(run, "path string, status string, page_no int, width double, height double, rotate int, content binary, fonts string")


def page_columns(part: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    """The columns of a batch of pages row by row; only one row's content is a Python object at a time."""
    for row in zip(*[part.column(n) for n in names], strict=True):
        yield tuple(x.as_py() for x in row)


def read_glyphs(pages: DataFrame) -> DataFrame:
    """``source, page_no, glyph_no, text, l, t, r, b, size``: characters with boxes as fractions of the page from its top left.

    They leave in batches of a bounded size, also those of one page.
    """

    def batch(held: list[tuple]) -> pa.RecordBatch:
        n = [len(run.texts) for *_, run in held]
        each = lambda values, kind: np.repeat(np.array(values, kind), n)
        joined = lambda c: np.concatenate([getattr(run, c) for *_, run in held])
        w, h = each([x[2] for x in held], float), each([x[3] for x in held], float)
        numbers = each([x[4] for x in held], np.int64) + np.arange(sum(n)) - np.repeat(np.cumsum(n) - n, n)
        source = pa.array([x[0] for x in held], pa.string()).take(pa.array(np.repeat(np.arange(len(held)), n)))
        columns = [
            source, pa.array(each([x[1] for x in held], np.int32)), pa.array(numbers.astype(np.int32)), pa.array([t for *_, run in held for t in run.texts], pa.string()),
            *map(pa.array, (joined("l") / w, 1 - joined("t") / h, joined("r") / w, 1 - joined("b") / h, each([run.size for *_, run in held], float))),
        ]
        return pa.RecordBatch.from_arrays(columns, ["source", "page_no", "glyph_no", "text", "l", "t", "r", "b", "size"])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for part in parts:
            for path, no, w, h, raw, fonts in page_columns(part, "path", "page_no", "width", "height", "content", "fonts"):
                at = 0
                for drawn_run in runs(raw, json.loads(fonts or "{}")):
                    held.append((path, no, w, h, at, drawn_run))
                    at += len(drawn_run.texts)
                    n += len(drawn_run.texts)
                    if n >= MOST_ROWS:
                        yield batch(held)
                        held, n = [], 0
        if held:
            yield batch(held)

    some = pages.where("page_no is not null").select("path", "page_no", "width", "height", "content", "fonts")
    return some.mapInArrow(run, "source string, page_no int, glyph_no int, text string, l double, t double, r double, b double, size double")


def page_texts(pages: DataFrame) -> DataFrame:
    """``path, page_no, text``: the characters of each page in the order in which they are drawn."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = [text_of(raw, json.loads(f or "{}")) for raw, f in page_columns(part, "content", "fonts")]
            yield pa.RecordBatch.from_arrays([part.column("path"), part.column("page_no"), pa.array(found, pa.string())], ["path", "page_no", "text"])

    return pages.where("page_no is not null").select("path", "page_no", "content", "fonts").mapInArrow(run, "path string, page_no int, text string")


def write_files(pages: DataFrame, packed_objects: bool = False) -> DataFrame:
    """``out, file``: pages (out, pos, width, height, rotate, content) put together into files by ``out``, in the order of ``pos``.

    A task reads its pages sorted by file, one file after the other; there is no call for each file.
    """
    kind = pages.schema["out"].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, made, key, held = [], [], None, 0

        def files(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in some], schema), pa.array([f for _, f in some], pa.binary())], ["out", "file"])

        schema = None
        for part in parts:
            schema = part.schema.field("out").type
            for out, width, height, rotate, content in page_columns(part, "out", "width", "height", "rotate", "content"):
                if rows and out != key:
                    made.append((key, write(rows, packed_objects)))
                    held += len(made[-1][1])
                    rows = []
                    if held > AT_ONCE or len(made) > MOST_ROWS:
                        yield files(made)
                        made, held = [], 0
                key = out
                rows.append({"width": width, "height": height, "rotate": rotate, "content": content})
        if rows:
            yield files([*made, (key, write(rows, packed_objects))])

    dealt = pages.select("out", "pos", "width", "height", "rotate", "content").repartition("out").sortWithinPartitions("out", "pos")
    return dealt.mapInArrow(run, f"out {kind.simpleString()}, file binary")


def conditions(pages: DataFrame) -> DataFrame:
    """``path, condition``: number of pages, -1 for a locked file, 0 for a damaged one."""
    count = F.count("page_no")
    return pages.groupBy("path").agg(F.when(F.max("status") == "locked", -1).otherwise(count).cast("int").alias("condition"))


@F.pandas_udf(StringType())
def load_losses(raw: pd.Series) -> pd.Series:
    """Why a file's objects can't all be read; null where they can."""
    return raw.map(lambda r: None if r is None else losses(bytes(r)))
