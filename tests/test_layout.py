"""Layout, geometry, codecs and pictures."""

import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliant.functions import codecs, geometry, imaging
from foliant.operators import layout, pixels


def lines_of(spec, size=10.0):
    rows = []
    for y, x, text in spec:
        for i, c in enumerate(text):
            rows.append(("s", 1, len(rows), c, (x + 5 * i) / 600, (y - size) / 800, (x + 5 * i + 5) / 600, y / 800, size, 600.0, 800.0))
    return rows


def test_blocks(spark):
    spec = [(100, 50, "This is the first line of a para-"), (112, 50, "graph that goes on over lines"), (124, 50, "and ends."), (136, 62, "An indented line starts another"), (148, 50, "which goes on."), (300, 50, "• a bullet stands alone"), (312, 50, "42"), (400, 270, "Title")]
    glyphs = spark.createDataFrame(lines_of(spec), "source string, page_no int, glyph_no int, text string, l double, t double, r double, b double, size double, width double, height double")
    runs = layout.runs(glyphs).orderBy("run_no").collect()
    assert [r.text for r in runs] == [t for _, _, t in spec]
    got = layout.blocks(glyphs).orderBy("block_no").collect()
    assert [r.text for r in got] == ["This is the first line of a paragraph that goes on over lines and ends.", "An indented line starts another which goes on.", "• a bullet stands alone", "Title"]
    assert [r.lines for r in got] == [3, 2, 1, 1]


def test_runs_break_at_gaps_and_drop_overprints():
    text, left = np.array(["a", "a", "b", "c", " "], object), np.array([0.0, 1, 7, 40, 45])
    found = layout.page_runs(text, left, left + 5, np.full(5, 10.0), np.full(5, 10.0), np.zeros(5, bool))
    assert [r[4:] for r in found] == [("ab", True), ("c", False)]
    assert layout.flowed(["hy-", "phen", "東", "京"]) == "hyphen 東京" and layout.flowed(["A-", "B", "x-", "Y", "", "z-", "9"]) == "A- B x- Y z- 9"
    assert layout.wrapped("aaa bb ccccccc d", 5, len) == ["aaa", "bb", "ccccc", "cc d"]
    assert layout.weightiest(np.array(["a", "b", "a"]), np.array([1, 2, 1])) == "b"
    assert layout.overprints(np.array(list("aaaab")), np.array([0.0, 1, 2, 6, 7]), np.array([5.0, 6, 7, 11, 12])).tolist() == [False, True, True, False, False]


def test_matrices(spark):
    rng = random.Random(1)
    rows = [([rng.uniform(-3, 3) for _ in range(6)], [rng.uniform(-3, 3) for _ in range(6)], rng.random(), rng.random()) for _ in range(20)] + [([1.0, 2.0, 2.0, 4.0, 0.0, 0.0], [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], 1.0, 1.0)]
    df = spark.createDataFrame(rows, "m array<double>, n array<double>, x double, y double")
    m, n, x, y = (F.col(c) for c in "mnxy")
    one = geometry.transformed(n, geometry.transformed(m, x, y)["x"], geometry.transformed(m, x, y)["y"])
    got = df.select(one.alias("a"), geometry.transformed(geometry.multiply(m, n), x, y).alias("b"), geometry.multiply(m, geometry.inverted(m)).alias("i"), geometry.inverted(m).alias("v")).collect()
    for r in got[:-1]:
        assert (r.a.x, r.a.y) == pytest.approx((r.b.x, r.b.y)) and r.i == pytest.approx([1, 0, 0, 1, 0, 0], abs=1e-6)
    assert got[-1].v is None
    shape = spark.createDataFrame([([(0.0, 0.0), (4.0, 0.0), (4.0, 3.0)],), ([(0.0, 0.0)],)], "p array<struct<x:double,y:double>>")
    assert [r.a for r in shape.select(geometry.polygon_area(F.col("p")).alias("a")).collect()] == [6.0, 0.0]


def test_polygons():
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    assert sum(map(geometry.area, geometry.subtracted(square, (2, 3, 5, 7)))) == pytest.approx(88)
    assert geometry.subtracted(square, (-1, -1, 11, 11)) == []
    assert geometry.segment_outside((0, 5), (10, 5), [(2, 0, 4, 9), (3, 0, 6, 9), (20, 0, 30, 9)]) == [((0.0, 5.0), (2.0, 5.0)), ((6.0, 5.0), (10, 5))]
    assert geometry.touches(square, (4, 4, 5, 5)) and geometry.touches(square, (-5, 4, 20, 5)) and not geometry.touches(square, (11, 0, 12, 5))
    points = geometry.curve((0, 0), (0, 10), (10, 10), (10, 0), 0.1)
    assert points[-1] == pytest.approx((10, 0)) and max(y for _, y in points) == pytest.approx(7.5, abs=0.1)


def test_codecs(spark):
    assert codecs.rc4(b"Key", b"Plaintext").hex().upper() == "BBF316E8D940AF0AD3"
    assert codecs.run_length(bytes([2, 65, 66, 67, 254, 68, 128, 9])) == b"ABCDDD" and codecs.run_length(bytes([5, 65])) is None
    assert codecs.hex_decode(b"48 65 6C6>x") == b"Hel`" and codecs.hex_decode(b"zz>") is None
    assert codecs.unpredict(bytes([1, 1, 2, 3]), 2, 1, 8, 4) == bytes([1, 2, 4, 7])
    df = spark.createDataFrame([(b"a" * 500,), (b"short",), (None,)], "d binary")
    got = df.select(codecs.packed(F.col("d")).alias("p")).collect()
    assert zlib.decompress(bytes(got[0].p)) == b"a" * 500 and bytes(got[1].p) == b"short" and got[2].p is None
    again = df.select(codecs.inflated(codecs.deflated(F.col("d"))).alias("x")).collect()
    assert bytes(again[0].x) == b"a" * 500 and again[2].x is None


def png(pixels):
    h, w, c = pixels.shape
    rows = []
    above = np.zeros((w, c), int)
    for i, row in enumerate(pixels.astype(int)):
        kind = i % 5
        left = np.vstack([np.zeros((1, c), int), row[:-1]])
        corner = np.vstack([np.zeros((1, c), int), above[:-1]])
        guess = [0 * row, left, above, (left + above) // 2, np.vectorize(codecs.paeth)(left, above, corner)][kind]
        rows.append(bytes([kind]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        above = row
    chunk = lambda name, body: struct.pack(">I", len(body)) + name + body + b"\0\0\0\0"
    header = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[c], 0, 0, 0)
    return imaging.PNG + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(b"".join(rows))) + chunk(b"IEND", b"")


def test_pictures():
    rng = np.random.default_rng(1)
    for c in (1, 3, 4):
        pixels = rng.integers(0, 256, (11, 7, c), np.uint8)
        assert (imaging.png_pixels(png(pixels)) == pixels).all() and imaging.kind(png(pixels)) == "png"
    exif = b"Exif\0\0MM\0*\0\0\0\x08\0\x01\x01\x12\0\x03\0\0\0\x01\0\x06\0\0\0\0\0\0"
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 20, 30, 3) + b"\0" * 3 + b"\xff\xda\0\0"
    assert imaging.jpeg_info(jpeg) == (30, 20, 3, 6) and imaging.jpeg_info(b"\xff\xd8\xff\xda") is None
    page = np.full((20, 30, 4), 255, np.uint8)
    assert imaging.content_bounds(page) is None
    page[5:8, 3:9, 0] = 100
    assert imaging.content_bounds(page) == (3, 5, 9, 8)
    flat = np.full((9, 9), 3.0)
    assert np.allclose(imaging.blurred(flat), 3) and np.allclose(imaging.gradients(flat), 0)
    ramp = np.tile(np.arange(9.0), (9, 1))
    assert np.allclose(imaging.gradients(ramp)[0][:, 1:-1], 8)
    assert imaging.shrunk(np.arange(16).reshape(4, 4), 2, 2).tolist() == [[2, 4], [10, 12]]
    assert imaging.fitted(100, 50, 20) == (20, 10) and imaging.fitted(5, 5, 20) == (5, 5)
    other = page.copy()
    other[0, 0, 1] = 0
    assert imaging.differing_cells(page, other, 10).tolist() == [[True, True, False], [True, True, False]]
    for turned in range(1, 9):
        a, b, c, d, e, f = imaging.placed(turned, 1.0, 2.0, 3.0, 4.0)
        corners = {(round(a * x + c * y + e, 6), round(b * x + d * y + f, 6)) for x in (0, 1) for y in (0, 1)}
        assert corners == {(1.0, 2.0), (4.0, 2.0), (1.0, 6.0), (4.0, 6.0)}


def test_markdown(spark):
    import io
    import zipfile

    from foliant.sources import markdown

    points = spark.createDataFrame([(1, "T", "Over.", 1, "b", 3), (1, "T", "Over.", 0, "a", 2), (2, "U", "", 0, "c", 1)], "doc_id int, title string, overview string, point_no int, text string, page_no int")
    got = {r.doc_id: r.markdown for r in markdown.summary(points).collect()}
    assert got == {1: "# Summary of T\n\nOver.\n\n- a (page 2)\n- b (page 3)", 2: "# Summary of U\n\n- c (page 1)"}
    pages = spark.createDataFrame([(1, 2, "**a** **b**"), (1, 1, " x "), (1, 3, " ")], "doc_id int, page_no int, text string")
    assert markdown.document(pages).first().markdown == "x\n\n---\n\n**a b**"
    texts = spark.createDataFrame([("﻿intro\n## A *b* `c` #\n# d",), ("none",)], "m string")
    assert [r.t for r in texts.select(markdown.title(F.col("m")).alias("t")).collect()] == ["A b c", ""]
    parts = spark.createDataFrame([(1, 0, b"x"), (2, 0, b"y"), (2, 1, b"z")], "job int, part int, file binary")
    files = {r.job: (bytes(r.file), r.format) for r in markdown.zipped(markdown.part_names(parts, "p", "pdf")).collect()}
    assert files[1] == (b"x", "pdf") and zipfile.ZipFile(io.BytesIO(files[2][0])).namelist() == ["p-1.pdf", "p-2.pdf"]


def test_covered_pixels_of_frames(spark):
    """Equal frames and boxes are worked out once, and every image and box still counts."""
    images = spark.createDataFrame([(i, i % 2, 0.0, 0.0, 4.0, 2.0, 4, 2) for i in range(6)] + [(0, 1, 0.0, 0.0, 4.0, 2.0, 4, 2)], "image long, page long, l double, t double, r double, b double, columns int, rows int")
    boxes = spark.createDataFrame([(0, 1.0, 0.0, 3.0, 2.0)] * 70 + [(1, 0.0, 1.0, 1.0, 2.0)], "page long, l double, t double, r double, b double")
    spans = pixels.covered_spans(images, boxes)
    counts = {(r.image, r.row, r.first, r.last): r["count"] for r in spans.groupBy("image", "row", "first", "last").count().collect()}
    assert counts == {(i, y, 1, 2): 70 for i in (0, 2, 4) for y in (0, 1)} | {(i, 1, 0, 0): 1 for i in (0, 1, 3, 5)}
    every = spark.range(7).selectExpr("id as image", "explode(sequence(0, 3)) as x").selectExpr("*", "explode(sequence(0, 1)) as y").withColumn("value", F.lit(9))
    covers = lambda i, x, y: (i in (0, 2, 4) and x in (1, 2)) or (i in (0, 1, 3, 5) and x == 0 and y == 1)
    want = sorted((i, x, y, 255 if covers(i, x, y) else 9) for i in range(7) for x in range(4) for y in range(2))
    for got in (pixels.redacted(every, spans, 255), pixels.redacted_under(every, images, boxes, 255)):
        assert sorted((r.image, r.x, r.y, r.value) for r in got.collect()) == want
    node = spans._jdf.queryExecution().optimizedPlan().toString()
    assert node.count("Aggregate [") == 3  # frames, boxes and their spans before the images join


def test_covered_rows_are_made_by_many_tasks(spark):
    """One small file of images becomes very many rows, which one task would make alone."""
    images = spark.createDataFrame([(i, 0, 0.0, 0.0, 4.0, 2.0, 4, 2) for i in range(300)], "image long, page long, l double, t double, r double, b double, columns int, rows int").coalesce(1)
    boxes = spark.createDataFrame([(0, 0.0, 0.0, 4.0, 2.0)] * 130, "page long, l double, t double, r double, b double").coalesce(1)
    made = pixels.covered_spans(images, boxes).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in made) == 300 * 2 * 130
    assert len(made) > spark.sparkContext.defaultParallelism and max(r["count"] for r in made) < 300 * 2 * 130 / 4
