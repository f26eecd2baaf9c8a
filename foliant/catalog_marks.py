"""Queries of geometry, colours and marks on pages: lines of orders stand for shapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.operators import marks, measures, pages, spatial
from foliant.registry import query, read

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEYS = ", ".join(KEY)
#: A box on a page, in fractions, and two numbers, from a line of an order.
BOX = "lines as (select *, l_linenumber / 20.0 as l, l_discount as t, l_linenumber / 20.0 + l_quantity / 100.0 as r, l_discount + l_tax + 0.05 as b, (l_partkey % 50)::double as p, (l_suppkey % 7)::double as s from lineitem)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q, d = F.col("l_linenumber") / 20.0, F.col("l_quantity") / 100.0, F.col("l_discount")
    return read(spark, sf_dir, "lineitem").withColumns({"l": n, "t": d, "r": n + q, "b": d + F.col("l_tax") + 0.05, "p": (F.col("l_partkey") % 50).cast("double"), "s": (F.col("l_suppkey") % 7).cast("double")})


def xy(x, y) -> Column:
    c = lambda v: v if isinstance(v, Column) else F.lit(float(v))
    return F.struct(c(x).alias("x"), c(y).alias("y"))


def col(name: str) -> Column:
    return F.col(name)


@query(f"with {BOX} select {KEYS}, round(p * 2 + t * s, 6) as a, round(p * r + t * 1.5, 6) as b, round(l * 2 + b * s + 7, 6) as other from lines")
def matrix_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(p, t, s, 1, l, b) and then (2, r, s, 1.5, 7, 8)."""
    one = F.array(col("p"), col("t"), col("s"), F.lit(1.0), col("l"), col("b"))
    two = F.array(F.lit(2.0), col("r"), col("s"), F.lit(1.5), F.lit(7.0), F.lit(8.0))
    m = geometry.multiply(one, two)
    return boxes(spark, sf_dir).select(*KEY, F.round(m[0], 6).alias("a"), F.round(m[1], 6).alias("b"), F.round(m[4], 6).alias("other"))


@query(f"with {BOX} select {KEYS}, round(abs((0 * 1 - p * 0) + (p * s - r * 1) + (r * 0 - 0 * s)) / 2, 6) as area from lines")
def polygon_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles (0, 0), (p, 1), (r, s)."""
    return boxes(spark, sf_dir).select(*KEY, F.round(geometry.polygon_area(F.array(xy(0, 0), xy(col("p"), 1), xy(col("r"), col("s")))), 6).alias("area"))


@query(f"with {BOX} select {KEYS}, round(greatest(least(l, b, 0.3) - 0.02, 0), 6) as l, round(greatest(least(t, r, 0.4) - 0.02, 0), 6) as t, round(least(greatest(l, b, 0.3) + 0.02, 1), 6) as r, round(least(greatest(t, r, 0.4) + 0.02, 1), 6) as b from lines")
def mark_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.array(xy(col("l"), col("t")), xy(col("b"), col("r")), xy(0.3, 0.4))
    return boxes(spark, sf_dir).select(*KEY, marks.extent(points, F.lit(0.02)).alias("e")).select(*KEY, *[F.round(f"e.{c}", 6).alias(c) for c in "ltrb"])


@query(f"""with {BOX}, moved as (select *, 0.1 + (0.25 - l) / (r - l) * 0.6 as x, case when p > 0 then 0.2 + (0.5 - t) / p * 0.5 else 0.5 + 0.2 - t end as y from lines)
select {KEYS}, round(least(greatest(x, 0), 1), 6) as x, round(least(greatest(y, 0), 1), 6) as y from moved""")
def refit_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A point (0.25, 0.5) that moves with its box, which is flat where p is 0."""
    box = lambda l, t, r, b: F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"))
    old, new = box(col("l"), col("t"), col("r"), col("t") + col("p")), box(F.lit(0.1), F.lit(0.2), F.lit(0.7), F.lit(0.7))
    at = marks.refit(F.array(xy(0.25, 0.5)), old, new)[0]
    return boxes(spark, sf_dir).select(*KEY, F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query(f"with {BOX}, d as (select *, greatest(least(0.3, 1 - r), -l) as x, greatest(least(-0.05, 1 - b), -t) as y from lines) select {KEYS}, round(l + x, 6) as l, round(t + y, 6) as t, round(r + x, 6) as r, round(b + y, 6) as b from d")
def moved_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = marks.moved(F.struct(*[col(c) for c in "ltrb"]), F.lit(0.3), F.lit(-0.05))
    return boxes(spark, sf_dir).select(*KEY, m.alias("m")).select(*KEY, *[F.round(f"m.{c}", 6).alias(c) for c in "ltrb"])


@query(f"""with {BOX}, a as (select *, atan2(s - 1, p - 2) as angle, (l_linenumber * 3 + 4)::double as size from lines)
select {KEYS}, round(p - size * cos(angle + pi() / 6), 6) as x0, round(s - size * sin(angle + pi() / 6), 6) as y0, round(p - size * cos(angle - pi() / 6), 6) as x1, round(s - size * sin(angle - pi() / 6), 6) as y1 from a""")
def arrow_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = marks.arrow_head(F.lit(2.0), F.lit(1.0), col("p"), col("s"), col("l_linenumber").cast("double"))
    found = boxes(spark, sf_dir).select(*KEY, head.alias("h"))
    return found.select(*KEY, *[F.round(F.col("h")[i][c], 6).alias(f"{c}{i}") for i in (0, 1) for c in "xy"])


@query(f"""with {BOX}, w as (select *, 3 - 2 * least(l, 1) as one, 3 - 2 * least(r, 1) as two, 3 - 2 * least(t * 10, 1) as three from lines), m as (select *, one + 0.35 * (two - one) as mixed from w)
select {KEYS}, round(one, 6) as w0, round(mixed, 6) as w1, round(mixed + 0.35 * (three - mixed), 6) as w2 from m""")
def signature_widths(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = boxes(spark, sf_dir).select(*KEY, marks.ink_widths(F.array(col("l"), col("r"), col("t") * 10), 1.0, 3.0).alias("w"))
    return found.select(*KEY, *[F.round(F.col("w")[i], 6).alias(f"w{i}") for i in range(3)])


@query(f"""with {BOX}, n as (select *, greatest(ceil((r - l) / 0.04::double), 1)::integer as n from lines), p as (select *, unnest(generate_series(0, n)) as i from n)
select {KEYS}, i::integer as i, round(least(l + i * 0.04, r), 6) as x, round(b - case when i % 2 = 0 then 0 else (b - t) / 12 end, 6) as y from p""")
def squiggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = marks.zigzag(col("l"), col("t"), col("r"), col("b"), 0.04)
    return boxes(spark, sf_dir).select(*KEY, F.posexplode(points).alias("i", "z")).select(*KEY, "i", F.round("z.x", 6).alias("x"), F.round("z.y", 6).alias("y"))


@query("""with f as (select o_orderkey as source, 1 as page_no, (100 + o_orderkey % 300)::double as width, (150 + o_custkey % 200)::double as height from orders),
g as (select *, unnest(generate_series(0, floor(height / 70)::integer + 1)) as row_no from f), c as (select *, unnest(generate_series(0, floor(width / 90)::integer + 1)) as col_no from g),
p as (select *, col_no * 90.0 - case when row_no % 2 = 1 then 45.0 else 0 end as x, row_no * 70.0 as y from c)
select source, page_no::integer as page_no, x::double as x, y::double as y from p where x > -40 and x < width + 40 and y < height + 30""")
def watermark_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.lit(1).alias("page_no"), (100 + F.col("o_orderkey") % 300).cast("double").alias("width"), (150 + F.col("o_custkey") % 200).cast("double").alias("height"))
    return marks.tiles(frames, 40.0, 30.0, 10.0)


POINTS = "anchors as (select l_orderkey as key, row_number() over (partition by l_orderkey order by l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) as pos, (l_partkey % 100)::double as a, (l_suppkey % 10)::double as b from lineitem)"


@query(f"""with recursive {POINTS}, kept as (select key, pos, a, b, true as keep from anchors where pos = 1
union all select n.key, n.pos, case when n.a > k.a and n.b > k.b then n.a else k.a end, case when n.a > k.a and n.b > k.b then n.b else k.b end, n.a > k.a and n.b > k.b from kept k join anchors n on n.key = k.key and n.pos = k.pos + 1)
select key, a, b from kept where keep""")
def scroll_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    anchors = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("key"), F.row_number().over(order).alias("pos"), (F.col("l_partkey") % 100).cast("double").alias("a"), (F.col("l_suppkey") % 10).cast("double").alias("b"))
    return marks.sync_points(anchors)


@query(f"with {BOX} select {KEYS}, regexp_replace(regexp_replace(printf('%.5f', p / 8 - 2), '0+$', ''), '[.]$', '') as text from lines")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).select(*KEY, marks.number_text(col("p") / 8 - 2).alias("text"))


@query(f"""with {BOX}, c as (select *, ['gray', 'tint', 'rgb', 'cmyk', 'lab'][(l_partkey % 5 + 1)::integer] as space, [t, l / 2, b / 2, 0.25] as v from lines)
select {KEYS}, round(case space when 'gray' then v[1] when 'tint' then 1 - v[1] when 'rgb' then v[1] when 'cmyk' then (1 - v[1]) * 0.75 end, 6) as red,
  round(case space when 'gray' then v[1] when 'tint' then 1 - v[1] when 'rgb' then v[3] when 'cmyk' then (1 - v[3]) * 0.75 end, 6) as blue from c""")
def colors_in_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = F.element_at(F.array(*map(F.lit, ("gray", "tint", "rgb", "cmyk", "lab"))), (col("l_partkey") % 5 + 1).cast("int"))
    rgb = geometry.rgb_of(space, F.array(col("t"), col("l") / 2, col("b") / 2, F.lit(0.25)))
    return boxes(spark, sf_dir).select(*KEY, rgb.alias("c")).select(*KEY, F.round(F.col("c")[0], 6).alias("red"), F.round(F.col("c")[2], 6).alias("blue"))


@query(f"""with {BOX}, c as (select *, greatest(ceil(round(sqrt(0.75 * greatest(sqrt(pow(0 - 2 * p + 9, 2) + pow(0 - 2 * s + 4, 2)), sqrt(pow(p - 18 + 20, 2) + pow(s - 8 + 1, 2))) / 0.5), 9)), 1)::integer as n from lines),
u as (select *, unnest(generate_series(1, n)) as i from c), w as (select *, i / n::double as t_ from u)
select {KEYS}, i::integer as i, round(3 * pow(1 - t_, 2) * t_ * p + 3 * (1 - t_) * t_ * t_ * 9 + pow(t_, 3) * 20, 6) as x, round(3 * pow(1 - t_, 2) * t_ * s + 3 * (1 - t_) * t_ * t_ * 4 + pow(t_, 3) * 1, 6) as y from w""")
def flattened_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cubic (0, 0), (p, s), (9, 4), (20, 1)."""
    at = lambda x, y: F.array(x if isinstance(x, Column) else F.lit(float(x)), y if isinstance(y, Column) else F.lit(float(y)))
    points = geometry.flattened(F.array(at(0, 0), at(col("p"), col("s")), at(9, 4), at(20, 1)), F.lit(0.5))
    return boxes(spark, sf_dir).select(*KEY, F.posexplode(points).alias("i", "z")).select(*KEY, (F.col("i") + 1).alias("i"), F.round("z.x", 6).alias("x"), F.round("z.y", 6).alias("y"))


@query(f"""with {BOX}, o as (select *, greatest(least(r, 0.4) - greatest(l, 0.15), 0) * greatest(least(b, 0.12) - greatest(t, 0.03), 0) as common from lines)
select {KEYS}, round((r - l) * (b - t) - common, 6) as uncovered, l <= 0.4 and r >= 0.15 and t <= 0.12 and b >= 0.03 as meets,
  round((r - l) - case when (t + b) / 2 between 0.03 and 0.12 then greatest(least(r, 0.4) - greatest(l, 0.15), 0) else 0 end, 6) as outside from o""")
def covered_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the area (0.15, 0.03) to (0.4, 0.12) leaves of boxes, which boxes it meets, and how much of their middle line lies outside."""
    shape, rect = geometry.corners(*[col(c) for c in "ltrb"]), F.array(*[F.lit(v) for v in (0.15, 0.03, 0.4, 0.12)])
    middle = (col("t") + col("b")) / 2
    line = F.array(F.array(col("l"), middle), F.array(col("r"), middle))
    return boxes(spark, sf_dir).select(
        *KEY, F.round(geometry.area_left(shape, rect), 6).alias("uncovered"), geometry.meet(shape, rect).alias("meets"), F.round(geometry.length_outside(line, F.array(rect)), 6).alias("outside")
    )


@query(f"""with {BOX}, c as (select *, greatest(l * 600, 0) as x0, least(r * 600, 600) as x1, greatest((1 - b) * 800, 0) as y0, least((1 - t) * 800, 800) as y1 from lines)
select {KEYS}, round(x0, 3) as x0, round(y0, 3) as y0, round(greatest(x1, x0 + 3), 3) as x1, round(greatest(y1, y0 + 3), 3) as y1, false as whole from c""")
def cropped_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pages.crop(boxes(spark, sf_dir).withColumns({"width": F.lit(600.0), "height": F.lit(800.0)}))
    return out.select(*KEY, *[F.col("box")[i].alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))], "whole")


#: Boxes on the page of their part: recognised words, and what is there already or marks them.
WORDS = """w as (select l_partkey as source, 1 as page_no, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)::integer as glyph_no,
  l_linenumber / 10.0 as l, l_discount * 9 as t, l_linenumber / 10.0 + 0.08 as r, l_discount * 9 + 0.04 as b from lineitem),
there as (select p_partkey as source, 1 as page_no, 0.05 + (p_size % 7) / 10.0 as l, 0.0 as t, 0.35 + (p_size % 7) / 10.0 as r, (p_size % 4) / 5.0 + 0.02 as b from part),
met as (select w.*, greatest(least(w.r, t.r) - greatest(w.l, t.l), 0) * greatest(least(w.b, t.b) - greatest(w.t, t.t), 0) as o from w join there t using (source, page_no))"""


def word_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    n, d = F.col("l_linenumber") / 10.0, F.col("l_discount") * 9
    words = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("source"), F.lit(1).alias("page_no"), F.row_number().over(order).alias("glyph_no"), n.alias("l"), d.alias("t"), (n + 0.08).alias("r"), (d + 0.04).alias("b"))
    left = (F.col("p_size") % 7) / 10.0
    there = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.lit(1).alias("page_no"), (0.05 + left).alias("l"), F.lit(0.0).alias("t"), (0.35 + left).alias("r"), ((F.col("p_size") % 4) / 5.0 + 0.02).alias("b"))
    return words, there


@query(f"with {WORDS} select source, page_no, glyph_no from met where not o >= (r - l) * (b - t) * 0.5 - 1e-12")
def fresh_recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, there = word_boxes(spark, sf_dir)
    glyphs = there.withColumns({"text": F.lit("x"), "t": F.col("t") - 1e-9})
    return spatial.fresh_words(words, glyphs).select("source", "page_no", "glyph_no")


@query(f"with {WORDS} select source, page_no, glyph_no from met where not o >= (r - l) * (b - t) * 0.98 - 1e-12")
def unmarked_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, there = word_boxes(spark, sf_dir)
    return spatial.unmarked(words, there.withColumn("t", F.col("t") - 1e-9)).select("source", "page_no", "glyph_no")


@query(f"""with {WORDS}, p as (select p_partkey as source, 1 as page_no, (p_size % 10) / 10.0 as x, (p_size % 6) / 6.0 as y from part),
d as (select source, glyph_no, sqrt(pow(greatest(l - x, x - r, 0), 2) + pow(greatest(t - y, y - b, 0), 2)) as distance from w join p using (source, page_no)),
r as (select *, row_number() over (partition by source order by round(distance, 12), glyph_no) as k from d where distance <= 0.25)
select source, 1 as page_no, 0 as point_no, glyph_no, round(distance, 6) as distance from r where k = 1""")
def nearest_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, _ = word_boxes(spark, sf_dir)
    points = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.lit(1).alias("page_no"), F.lit(0).alias("point_no"), ((F.col("p_size") % 10) / 10.0).alias("x"), ((F.col("p_size") % 6) / 6.0).alias("y"))
    return spatial.nearest(words, points, 0.25).withColumn("distance", F.round("distance", 6))


@query("with c as (select source, lang, count(*) as n, max(doc_id) as last from documents group by all) select source, arg_max(lang, n::hugeint * 1000000000 - last) as mode, max(n) as amount from c group by source")
def plain_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.mode(read(spark, sf_dir, "documents"), ["source"], "lang", "doc_id")
