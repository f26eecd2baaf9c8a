"""Document operators against golden cases and brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import compare, forms, graphs, measures, pages, reading, retrieval, spatial
from foliant.sources import html, pdf


def one(spark, expr, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expr.alias("x")).first().x


def five(spark, n=5):
    return spark.createDataFrame([("d", i, 0, 612.0, 792.0) for i in range(1, n + 1)], "source string, page_no int, rotate int, width double, height double")


def test_combined_ranges(spark):
    got = pages.split_ranges(five(spark), [(3, 4), (1, 3)], combine=True).orderBy("pos").collect()
    assert [r.page_no for r in got] == [3, 4, 1, 2]
    for bad in ([], [(0, 2)], [(3, 2)]):
        with pytest.raises(ValueError):
            pages.split_ranges(five(spark), bad)
    with pytest.raises(ValueError):
        pages.split_every(five(spark), 0)


def test_every_two_pages(spark):
    got = pages.split_every(five(spark), 2).orderBy("page_no").collect()
    assert [r.part for r in got] == [0, 0, 1, 1, 2]


def test_page_numbers(spark):
    p = five(spark, 4)
    got = pages.number(p, p.where("page_no in (4, 2)").select("source", "page_no"), 1).orderBy("page_no").collect()
    assert [(r.page_no, r.label) for r in got] == [(2, "1/3"), (4, "3/3")]
    got = pages.number(p, p.select("source", "page_no"), 1, "Page {n} of {total}").orderBy("page_no").collect()
    assert [r.label for r in got][::3] == ["Page 1 of 4", "Page 4 of 4"]


def test_page_range(spark):
    for spec, most, want in (("1,3-5", 9, [1, 3, 4, 5]), ("3x, ,-5,2-", 9, [3]), ("5-99,1", 6, [1, 5, 6]), ("", 5, None), ("1", 0, None), ("8-9", 5, None), ("1-2-9", 5, [1, 2])):
        assert one(spark, pages.page_range(F.col("c0"), F.lit(most)), spec) == want, spec


def test_organize_refuses(spark):
    schema = "pos int, kind string, source string, page_no int, turn int, width double, height double"
    good = [(2, "page", "d", 1, 90, None, None), (1, "page", "d", 3, 0, None, None), (3, "blank", None, None, 0, 200.0, 300.0)]
    got = pages.organize(five(spark), spark.createDataFrame(good, schema)).orderBy("pos").collect()
    assert [(r.page_no, r.rotate) for r in got] == [(3, 0), (1, 90), (None, 0)]
    for bad in ((4, "page", "d", 1, 0, None, None), (4, "page", "d", 9, 0, None, None), (4, "page", "d", 2, 45, None, None), (4, "blank", None, None, 0, 0.5, 10.0)):
        with pytest.raises(Exception, match="placed twice|no such page|right angle|impossible size"):
            pages.organize(five(spark), spark.createDataFrame([*good, bad], schema)).collect()


def test_crop(spark):
    frame = spark.createDataFrame([(100.0, 200.0, 0.1, 0.25, 0.5, 0.5), (100.0, 200.0, 0.0, 0.0, 1.0, 1.0), (100.0, 200.0, 0.5, 0.5, 0.5, 0.5)], "width double, height double, l double, t double, r double, b double")
    got = pages.crop(frame).collect()
    assert got[0].box == [10.0, 100.0, 50.0, 150.0] and not got[0].whole and got[1].whole and got[2].box == [50.0, 100.0, 53.0, 103.0]


def test_text_functions(spark):
    assert one(spark, T.word_set(F.col("c0")), "The cats, cat's 2 boxes 東京都 été étés ab") == ["cat", "boxe", "東京", "京都", "été"]
    assert one(spark, T.shape(F.col("c0")), "Page 12 of 345") == "page # of #"
    assert one(spark, T.listed_points(F.col("c0")), "Points:\n- a **b**\n2) c\nrest") == ["a b", "c"]
    assert one(spark, T.listed_points(F.col("c0")), "Here:\nplain\n") == ["plain"]
    assert one(spark, T.is_blank(F.col("c0")), "  \n") is True and one(spark, T.is_blank(F.col("c0")), " x") is False
    assert one(spark, T.xml_escape(F.col("c0")), 'a<b>&"\x01') == "a&lt;b&gt;&amp;&quot;"
    assert [one(spark, T.xmp_date(F.col("c0")), d) for d in ("D:20240131120305+02'30'", "D:2024", "D:202413", "D:20240131")] == ["2024-01-31T12:03:05+02:30", "2024", None, "2024-01-31"]
    assert one(spark, T.utf16_hex(F.col("c0")), "é") == "<FEFF00E9>" and one(spark, T.utf16_hex(F.col("c0")), "plain") == "plain"
    assert [one(spark, T.page_list(F.array(*map(F.lit, p))), "") for p in ([1, 2, 5], [3])] == ["pages 1, 2 and 5", "page 3"]
    assert one(spark, T.nfkc(F.col("c0")), "ﬁne") == "fine"
    assert (T.osa("ca", "abc"), T.osa("abcd", "abdc"), T.osa("", "ab"), T.osa("same", "same")) == (3, 1, 2, 0)
    assert [T.marker(k, n) for k, n in (("upper-roman", 1994), ("lower-alpha", 28), ("decimal-leading-zero", 7), ("disc", 1), ("none", 1), ("lower-greek", 24), ("upper-alpha", 0))] == ["MCMXCIV.", "ab.", "07.", "•", None, "ω.", "0."]


def words(text):
    out = []
    for w in re.findall(r"[^\W_]+", text.lower()):
        if len(w) > 2 and w not in T.STOP_WORDS:
            out.append(re.sub("s$", "", w))
    return set(out)


def test_excerpts(spark):
    docs = spark.createDataFrame([(1, "alpha beta\n" + "gamma delta " * 20 + "\nalpha gamma"), (2, "short"), (3, "one thing\n" + "filler words " * 10)], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "alpha?"), (2, "nothing"), (3, "unknown")], "doc_id long, question string")
    got = retrieval.excerpts(retrieval.paragraphs(docs), asked, 30).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.par_no)
    assert by == {1: [0, 2], 2: [0], 3: [0]}


def test_parts():
    lines = ["a" * 10, "b c " * 10, "", "d"]
    packed = retrieval.pack(lines, 20)
    assert "".join(p for _, no, p in packed if no == 1).replace(" ", "") == "bc" * 10
    assert all(len(p) <= 20 for _, _, p in packed) and packed[0] == (0, 0, "a" * 10) and packed[-1][2] == "d"
    assert retrieval.pack(["x" * 50], 20) == [(0, 0, "x" * 20), (1, 0, "x" * 20), (2, 0, "x" * 10)]


def test_found(spark):
    pars = spark.createDataFrame([(1, 0, "Of  the of the OF"), (1, 1, "oﬃce of the")], "doc_id long, par_no int, text string")
    assert sorted((r.par_no, r["at"]) for r in retrieval.found(pars, " of THE ").collect()) == [(0, 0), (0, 7), (1, 7)]
    assert retrieval.found(pars, "  ").count() == 0 and retrieval.found(pars, "office").count() == 1


def test_coverage_by_brute_force(spark):
    rng = random.Random(4)
    box = lambda: (lambda x, y, w, h: (x, y, min(1.0, x + w), min(1.0, y + h)))(rng.random(), rng.random(), rng.random() * 0.2, rng.choice([0.0, 0.05, 0.6]))
    glyphs = [("s", p, i, "x", *box()) for p in (1, 2) for i in range(60)]
    areas = [("s", p, *box()) for p in (1, 2) for _ in range(8)]
    got = {(r.page_no, r.glyph_no): (r.covered, r.inside) for r in spatial.with_cover(
        spark.createDataFrame(glyphs, "source string, page_no int, glyph_no int, text string, l double, t double, r double, b double"),
        spark.createDataFrame(areas, "source string, page_no int, l double, t double, r double, b double")).collect()}
    for _, p, i, _, l, t, r, b in glyphs:
        own = [a[2:] for a in areas if a[1] == p]
        size = (r - l) * (b - t)
        over = sum(max(0, min(r, c) - max(l, a)) * max(0, min(b, d) - max(t, e)) for a, e, c, d in own)
        centred = any(a <= (l + r) / 2 <= c and e <= (t + b) / 2 <= d for a, e, c, d in own)
        inside = any(l >= a and r <= c and t >= e and b <= d for a, e, c, d in own)
        assert got[p, i] == ((over >= 0.25 * size - 1e-12) if size > 1e-12 else centred, inside)


def test_intervals_and_nearest(spark):
    spans = spark.createDataFrame([("k", 1, 3), ("k", 2, 5), ("k", 5, 6), ("k", 8, 9), ("j", 0, 1)], "k string, a int, b int")
    assert sorted((r.k, r.a, r.b) for r in spatial.merged_intervals(spans, ["k"]).collect()) == [("j", 0, 1), ("k", 1, 6), ("k", 8, 9)]
    glyphs = spark.createDataFrame([("s", 1, 0, 0.0, 0.0, 0.1, 0.1), ("s", 1, 1, 0.2, 0.0, 0.3, 0.1)], "source string, page_no int, glyph_no int, l double, t double, r double, b double")
    points = spark.createDataFrame([("s", 1, 0, 0.15, 0.05), ("s", 1, 1, 0.25, 0.05), ("s", 1, 2, 0.9, 0.9)], "source string, page_no int, point_no int, x double, y double")
    assert sorted((r.point_no, r.glyph_no) for r in spatial.nearest(glyphs, points, 0.2).collect()) == [(0, 0), (1, 1)]


def test_share_identical_objects(spark):
    objects, refs = [], []
    for copy in range(3):
        base = copy * 10
        objects += [(base + 1, "program", "bytes"), (base + 2, "descriptor", "d"), (base + 3, "font", "f"), (base + 4, "page", f"p{copy}")]
        refs += [(base + 2, base + 1, "/FontFile"), (base + 3, base + 2, "/FontDescriptor"), (base + 4, base + 3, "/Font")]
    left, edges = graphs.share_identical(spark.createDataFrame(objects, "id long, kind string, content string"), spark.createDataFrame(refs, "src long, dst long, path string"))
    kinds = [r.kind for r in left.collect()]
    assert sorted(kinds) == ["descriptor", "font", "page", "page", "page", "program"]
    assert {(r.src, r.dst) for r in edges.collect()} == {(2, 1), (3, 2), (4, 3), (14, 3), (24, 3)}


def test_graph_walks(spark):
    refs = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (3, 9)], "src long, dst long")
    objects = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    assert sorted(r.id for r in graphs.unreachable(objects, refs, objects.where("id = 1")).collect()) == [4, 5]
    assert [(r.src, r.dst) for r in graphs.dangling(objects, refs).collect()] == [(3, 9)]
    new, moved = graphs.renumber(objects, refs, 10)
    assert sorted(r.id for r in new.collect()) == [10, 11, 12, 13, 14] and (12, 15) in {(r.src, r.dst) for r in moved.collect()}
    headings = spark.createDataFrame([("d", i, lv) for i, lv in enumerate((1, 3, 2, 2, 3, 1, 2))], "doc_id string, idx int, level int")
    parents = graphs.heading_parents(headings)
    assert [r.parent for r in parents.orderBy("idx").collect()] == [None, 0, 0, 0, 3, None, 5]
    assert [r.below for r in graphs.subtree_counts(parents).orderBy("idx").collect()] == [4, 0, 0, 1, 0, 1, 0]


def test_measures(spark):
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate([4, 1, 3, 2])], "k string, v int, i int")
    assert measures.upper_median(df, ["k"], "v").first().median == 3
    df = spark.createDataFrame([("k", v, i) for i, v in enumerate("abba")], "k string, v string, i int")
    assert measures.mode(df, ["k"], "v", "i").first().mode == "b" and measures.vote(df, ["k"], "v", "i").first().winner == "a"
    items = spark.createDataFrame([("l", i, v, 3, s) for i, (v, s) in enumerate([(None, 1), (None, 1), (10, 1), (None, 1)])], "list_id string, pos int, value int, start int, step int")
    assert [r.ordinal for r in measures.list_ordinals(items).orderBy("pos").collect()] == [3, 4, 10, 11]


def test_shortest_edit_is_shortest():
    rng = random.Random(6)
    for _ in range(150):
        a, b = ([rng.choice("abc") for _ in range(rng.randint(0, 14))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        pairs = compare.shortest_edit(a, b)
        assert len(pairs) == table[-1][-1] and all(a[i] == b[j] for i, j in pairs)
        assert all(p < q for p, q in zip(pairs, pairs[1:], strict=False)) and all(p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert compare.shortest_edit(list("abcdef"), list("uvwxyz"), 3) is None


def test_compare(spark):
    df = spark.createDataFrame([(1, "one two\nthree hy-\nphen end", "one 2\nthree hyphen\nend more"), (2, "same", "same"), (3, None, "new")], "k int, original string, changed string")
    got = compare.compare(df, "k").collect()
    assert [(r.k, r.removed, r.added) for r in got] == [(1, "two", "2"), (1, "", "more"), (2, None, None), (3, "", "new")]
    assert [(r.kind, r.comment) for r in compare.marked(compare.compare(df, "k")).collect()] == [("highlight", "Was: two"), ("highlight", ""), ("highlight", "")]
    assert compare.anchors([(0, 0), (1, 1), (3, 2)] + [(4 + i, 3 + i) for i in range(30)]) == [(0, 0), (3, 2), (21, 20)]


def test_forms(spark):
    fields = spark.createDataFrame([("s", "a", "text", ["x"], 3, None), ("s", "b", "combo", ["1"], None, ["1", "2"]), ("s", "c", "check", None, None, None)], "source string, name string, kind string, value array<string>, max_length int, options array<string>")
    fills = spark.createDataFrame([("s", "a", ["long text"]), ("s", "b", ["3"]), ("s", "z", ["1"]), ("s", "c", None)], "source string, name string, value array<string>")
    assert {r.name: r.problem for r in forms.checked_fills(fields, fills).collect()} == {"a": "too long", "b": "not offered", "z": "no such field", "c": None}
    assert sorted(r.name for r in forms.changed_fields(fields, fills).collect()) == ["a", "b"]
    marks = spark.createDataFrame([("Link", 0, True, None), ("Popup", 0, True, None), ("Square", 2, True, None), ("Square", 32, True, None), ("Square", 0, False, None), ("Widget", 4, True, None)], "subtype string, flags int, has_appearance boolean, stale boolean")
    assert [r.status for r in forms.flatten_status(marks).collect()] == ["out of scope", "removed", "removed", "on paper only", "kept", "drawn"]


def test_pdf_round_trip(spark):
    texts = ["Hello (World) \\ one", "two\nlines é", "Hello (World) \\ one"]
    made = [{"width": 600, "height": 800, "rotate": 90 * i, "content": pdf.text_content(t)} for i, t in enumerate(texts)]
    raw = pdf.write(made)
    assert raw.count(b"stream\n") == 4 and pdf.page_rows(raw)[0] == "readable"
    damaged = raw.replace(b"/Kids", b"/Gone")
    locked = raw.replace(b"trailer\n<<", b"trailer\n<< /Encrypt 9 0 R")
    files = spark.createDataFrame([("a", raw), ("b", b"junk"), ("c", damaged), ("d", locked), ("e", None)], "path string, content binary")
    read = pdf.read_pages(files)
    assert {r.path: r.condition for r in pdf.conditions(read).collect()} == {"a": 3, "b": 0, "c": 0, "d": -1, "e": 0}
    glyphs = pdf.read_glyphs(read).toPandas().sort_values(["page_no", "glyph_no"])
    assert glyphs.groupby("page_no").text.agg("".join).tolist() == [t.replace("\n", "") for t in texts]
    out = pdf.write_files(read.where("page_no is not null").withColumns({"out": F.lit(1), "pos": -F.col("page_no")})).first()
    again = pdf.page_rows(bytes(out.file))[1]
    assert [p["rotate"] for p in again] == [180, 90, 0] and again[2]["content"] == made[0]["content"]
    words_ = spatial.words(spark.createDataFrame(glyphs.astype({"page_no": "int32", "glyph_no": "int32"})))
    assert [r.text for r in words_.where("page_no = 2").orderBy("word_no").collect()] == ["two", "lines", "é"]


def test_html(spark):
    page = '<title>T &amp; x</title><h1>A <b>b</b></h1><h2> </h2><a class="k" href="#top">t</a><a href="/x">n</a><a href="HTTPS://e.org">e</a><script>x("</p>")</script><base href="q"><img src="http://i"><img src="data:x">'
    df = spark.createDataFrame([(1, page)], "k int, html string")
    assert [(r.level, r.title) for r in html.headings(df, "k").collect()] == [(1, "A b")]
    assert [(r.n, r.kind) for r in html.links(df, "k").collect()] == [(1, "place"), (3, "address")]
    clean = df.select(html.sanitized(F.col("html")).alias("x"), html.skipped_images(F.col("html")).alias("n")).first()
    assert "script" not in clean.x and "<base" not in clean.x and clean.n == 1
    raw = spark.createDataFrame([('<meta charset="latin1">é'.encode("latin-1"),), ("﻿é".encode(),), ("é".encode("utf-16"),), ("é".encode(),)], "raw binary")
    assert [r.x[-1] for r in raw.select(html.decoded(F.col("raw")).alias("x")).collect()] == ["é"] * 4


def grid(spark):
    """Few glyphs, which Spark would broadcast: one row of a table with a row for each of them."""
    return spark.range(3).select(F.col("id").alias("source"), F.lit(1).alias("page_no"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("glyph_no")).selectExpr("*", "'a' as text", "glyph_no * 0.1D as l", "0.1D as t", "glyph_no * 0.1D + 0.05D as r", "0.2D as b")


def test_joins_of_glyphs_are_never_broadcast(spark):
    kept = spatial.kept(grid(spark), grid(spark).where("glyph_no < 5"))
    assert kept.count() == 15
    assert "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()


def test_pdf_files_and_texts_in_streams(spark):
    rows = [(k, i, 612.0, 792.0, 0, pdf.text_content(f"{k} (page) {i}\n\\é")) for k in (1, 2, None) for i in range(3)]
    files = pdf.write_files(spark.createDataFrame(rows, "out long, pos int, width double, height double, rotate int, content binary"))
    assert "FlatMapGroups" not in files._jdf.queryExecution().executedPlan().toString()  # no call for each file
    read = pdf.read_pages(files.select(F.col("out").cast("string").alias("path"), F.col("file").alias("content")))
    assert {(r.path, r.page_no): r.text for r in pdf.page_texts(read).collect()} == {(None if k is None else str(k), i + 1): f"{k} (page) {i}\\é" for k, i, *_ in rows}
    assert pdf.read_glyphs(read).groupBy("source", "page_no").agg(F.max("glyph_no")).count() == 9
    strings = pdf.runs(pdf.text_content("ab\ncde") + b"\n/never" * 9)  # glyphs leave string by string, not page by page
    assert next(strings).texts == ["a", "b"] and pdf.text_of(pdf.text_content("ab\ncde")) == "abcde"


def test_codes_and_words_at_points_stay_off_the_driver(spark):
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    words = spark.range(20).selectExpr("id % 2 as key", "0 as side", "id as pos", "string(id % 5) as word")
    assert sorted(map(tuple, compare.codes(words).collect())) == sorted((k, str((k + 2 * i) % 5), i) for k in (0, 1) for i in range(5))
    assert "Broadcast" not in plan(compare.interned(words))
    points = spark.range(3).selectExpr("id as source", "1 as page_no", "0 as point_no", "0.32D as x", "0.15D as y")
    found = reading.word_at(grid(spark), points)
    assert {(r.source, r.text, round(r.l, 6)) for r in found.collect()} == {(s, "a", 0.3) for s in range(3)}
    assert "Broadcast" not in plan(found)
