"""Archive rules, marks and fonts."""

import pytest
from pyspark.sql import functions as F

from foliant.functions import fonts
from foliant.operators import archive, marks


def test_archive_rules(spark):
    files = spark.createDataFrame([(1, True, 1, 2, ["b"], 1), (2, False, 1, 2, [], 0), (3, False, 1, 3, ["b", "a"], 0), (4, False, 0, 2, [], 2), (5, False, 0, 2, [], 0)], "k int, dynamic_form boolean, attachments int, part int, lost_fonts array<string>, bare_annotations int")
    got = {r.k: r.reason for r in archive.refusals(files).collect()}
    assert got[1].startswith("its form") and "part 2" in got[2] and got[3].endswith("a, b") and "appearance" in got[4] and got[5] is None
    actions = spark.createDataFrame([("Launch", None), ("Named", "NextPage"), ("Named", "Print"), ("URI", None)], "k string, n string")
    assert [r.x for r in actions.select(archive.is_forbidden_action(F.col("k"), F.col("n")).alias("x")).collect()] == [True, False, True, False]
    configs = spark.createDataFrame([("s", 0, "A"), ("s", 1, "A"), ("s", 2, None), ("s", 3, "B")], "source string, pos int, name string")
    assert [r.name for r in archive.unique_names(configs).orderBy("pos").collect()] == ["A", "A 2", "Layers", "B"]
    one = spark.range(1).select(
        archive.blend_mode(F.array(F.lit("Odd"), F.lit("Screen"))).alias("b"), archive.clamped(F.lit(1 << 40)).alias("c"), archive.completed_order(F.array(F.lit(2)), F.array(F.lit(1), F.lit(2), F.lit(3))).alias("o"),
        archive.clean_catalog(F.create_map(F.lit("AA"), F.lit(1), F.lit("Pages"), F.lit(2))).alias("m"),
    ).first()
    assert (one.b, one.c, one.o, one.m) == ("Screen", (1 << 31) - 1, [2, 1, 3], {"Pages": 2})
    pages = spark.createDataFrame([("a", True, True, None), ("a", False, False, None), ("b", True, False, 4)], "source string, uses_rgb boolean, uses_cmyk boolean, intent_components int")
    assert {r.source: (r.intent, r.default_rgb, r.default_cmyk) for r in archive.output_intent(pages).collect()} == {"a": ("sRGB", False, True), "b": ("kept", True, False)}


def test_marks(spark):
    df = spark.createDataFrame([([(0.2, 0.2), (0.6, 0.4)], (0.2, 0.2, 0.6, 0.4), (0.0, 0.0, 0.4, 0.8))], "p array<struct<x:double,y:double>>, o struct<l:double,t:double,r:double,b:double>, n struct<l:double,t:double,r:double,b:double>")
    r = df.select(marks.extent(F.col("p"), F.lit(0.3)).alias("e"), marks.refit(F.col("p"), F.col("o"), F.col("n")).alias("f"), marks.moved(F.col("o"), F.lit(0.9), F.lit(-0.1)).alias("m")).first()
    assert (r.e.l, r.e.t) == (0.0, 0.0) and (r.e.r, r.e.b) == pytest.approx((0.9, 0.7))
    assert [(p.x, p.y) for p in r.f] == [pytest.approx((0, 0)), pytest.approx((0.4, 0.8))]
    assert (r.m.l, r.m.t, r.m.r, r.m.b) == pytest.approx((0.6, 0.1, 1.0, 0.3))
    h = spark.range(1).select(marks.arrow_head(F.lit(0.0), F.lit(0.0), F.lit(10.0), F.lit(0.0), F.lit(2.0)).alias("h"), marks.ink_widths(F.array(F.lit(0.0), F.lit(1.0)), 1.0, 3.0).alias("w"), marks.zigzag(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.2), 0.4).alias("z")).first()
    assert [p.x for p in h.h] == pytest.approx([10 - 10 * 3**0.5 / 2] * 2) and h.w == pytest.approx([3.0, 2.3]) and [p.x for p in h.z] == pytest.approx([0, 0.4, 0.8, 1.0])
    frames = spark.createDataFrame([("s", 1, 100.0, 50.0)], "source string, page_no int, width double, height double")
    assert marks.tiles(frames, 10, 10, 5).count() > 8
    with pytest.raises(Exception, match="too many"):
        marks.tiles(frames, 0.5, 0.5, 0).collect()
    anchors = spark.createDataFrame([("k", 0, 0.0, 0.0), ("k", 1, 2.0, 1.0), ("k", 2, 1.0, 3.0), ("k", 3, 3.0, 2.0)], "key string, pos int, a double, b double")
    assert [(r.a, r.b) for r in marks.sync_points(anchors).collect()] == [(0.0, 0.0), (2.0, 1.0), (3.0, 2.0)]
    numbers = spark.createDataFrame([(1.0,), (-0.000001,), (0.25,), (10.0,), (1.234567,)], "v double")
    assert [r.t for r in numbers.select(marks.number_text(F.col("v")).alias("t")).collect()] == ["1", "0", "0.25", "10", "1.23457"]


def test_fonts(spark):
    cmap = "begincodespacerange <00> <7F> <8140> <9FFC> endcodespacerange\n1 beginbfchar <01> <00660066> endbfchar\n2 beginbfrange <8140> <8142> <0041> <8150> <8151> [<0061> <0062>] endbfrange"
    spaces = fonts.code_spaces(cmap)
    assert [fonts.code_length(spaces, d) for d in (b"\x41", b"\x81\x40", b"\x81\x00", b"\xff")] == [1, 2, 2, 1]
    assert fonts.to_unicode(cmap) == {(1, 1): "ff", (2, 0x8140): "A", (2, 0x8141): "B", (2, 0x8142): "C", (2, 0x8150): "a", (2, 0x8151): "b"}
    used = {i: chr(0x4E00 + i) for i in range(150)} | {7: "😀"}
    assert fonts.to_unicode(fonts.write_to_unicode(used)) == {(2, k): v for k, v in used.items()}
    assert fonts.widths([1, [500.0, 600.0], 10, 12, 250.0]) == {1: 500.0, 2: 600.0, 10: 250.0, 11: 250.0, 12: 250.0}
    assert [fonts.glyph_text(n) for n in ("uni00660069", "u1F600", "f_i", "A.alt", "seven", "odd")] == ["fi", "😀", "fi", "A", "7", None]
    assert fonts.win_ansi("€") == 128 and fonts.win_ansi("ж") is None
    df = spark.createDataFrame([("plain é €",), ("жук",)], "t string")
    got = df.select(fonts.needs_embedding(F.col("t")).alias("n"), fonts.missing(F.col("t"), F.split(F.lit("plain"), "")).alias("m")).collect()
    assert [r.n for r in got] == [False, True] and [r.m for r in got] == ["é€", "жук"]
