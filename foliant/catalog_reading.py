"""Queries of reading order, form trees and annotations: parts' names as pages, orders and their lines as fields and annotations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.catalog import GLYPHS, RUNS, glyph_table, sized_glyphs
from foliant.operators import annotations, layout, reading, widgets
from foliant.registry import query, read


@query(f"with {GLYPHS} select source, page_no, (glyph_no % 60)::integer as place, text, round(l, 6) as l, round(b, 6) as b from glyphs")
def packed_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Glyphs packed into arrays and taken out again."""
    back = reading.unpacked(reading.packed(glyph_table(spark, sf_dir)))
    return back.select("source", "page_no", "place", "text", F.round("l", 6).alias("l"), F.round("b", 6).alias("b"))


APART = "(lag(glyph_no) over w is not null and (lag(row_no) over w <> row_no or l - lag(r) over w > greatest(lag(r) over w - lag(l) over w, r - l) / 3))"


@query(f"""with {GLYPHS}, a as (select source, page_no, glyph_no, lower(text) as text, {APART} as apart from glyphs window w as (partition by source, page_no order by glyph_no)),
c as (select source, page_no, glyph_no, 0 as half, ' ' as character, -1 as owner from a where apart union all select source, page_no, glyph_no, 1, case when trim(text) = '' then ' ' else text end, glyph_no from a),
k as (select *, lag(character) over (partition by source, page_no order by glyph_no, half) as was from c)
select source, page_no, (row_number() over (partition by source, page_no order by glyph_no, half) - 1)::integer as place, character, owner::integer as owner from k where character <> ' ' or was <> ' '""")
def searchable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.searchable(glyph_table(spark, sf_dir))


@query(f"""with {GLYPHS}, m as (select *, {APART} or lag(glyph_no) over w is null or trim(lag(text) over w) = '' as starts from glyphs window w as (partition by source, page_no order by glyph_no)),
s as (select *, sum((starts and trim(text) <> '')::integer) over (partition by source, page_no order by glyph_no rows between unbounded preceding and current row) as word_no from m),
words as (select source, page_no, word_no, string_agg(text, '' order by glyph_no) as text, min(l) as l, max(r) as r from s where trim(text) <> '' group by all),
points as (select distinct source, page_no, (source % 20) * 0.04 + 0.01 as x, 0.125 as y from glyphs),
hit as (select p.source, p.page_no, arg_min(word_no, glyph_no) as word_no from points p join s using (source, page_no) where x between l and r and y between t and b and trim(text) <> '' group by all)
select source, page_no, text, round(l, 6) as l, round(r, 6) as r from hit join words using (source, page_no, word_no)""")
def words_at_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    glyphs = glyph_table(spark, sf_dir)
    points = glyphs.select("source", "page_no").distinct().withColumns({"point_no": F.lit(0), "x": ((F.col("source") % 20) * F.lit(0.04) + 0.01).cast("double"), "y": F.lit(0.125)})
    return reading.word_at(glyphs, points).select("source", "page_no", "text", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"))


@query(f"""with {GLYPHS}, i as (select *, dense_rank() over (partition by source, page_no order by row_no) - 1 as line_no from glyphs where trim(text) <> '' and glyph_no between 7 and 97)
select source, page_no, line_no::integer as line_no, round(min(l), 6) as l, round(min(t), 6) as t, round(max(r), 6) as r, round(max(b), 6) as b from i group by all""")
def line_boxes_between(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading.text_between(glyph_table(spark, sf_dir), 97, 7).withColumns({c: F.round(c, 6) for c in "ltrb"})


@query(f"""with {RUNS}, n as (select *, row_number() over (partition by source, page_no order by row_no) - 1 as run_no from rows),
d as (select source, page_no, run_no, sqrt(pow(greatest(x0 - 290, 290 - x1, 0), 2) + pow(greatest(y - 24 - 250, 250 - y, 0), 2)) as distance from n)
select source, page_no, 0 as point_no, arg_min(run_no, round(distance, 9) * 1000 + run_no)::integer as run_no, round(min(distance), 6) as distance from d where distance <= 200 group by source, page_no""")
def nearest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = layout.runs(sized_glyphs(spark, sf_dir)).select("source", "page_no", "run_no", F.col("x0").alias("l"), (F.col("y") - F.col("size")).alias("t"), F.col("x1").alias("r"), F.col("y").alias("b"))
    points = runs.select("source", "page_no").distinct().withColumns({"point_no": F.lit(0), "x": F.lit(290.0), "y": F.lit(250.0)})
    return reading.nearest_run(runs, points, 200.0).withColumn("distance", F.round("distance", 6))


TEXTS = "['word', ' ', '--', 'x9', 'é']"
RECOGNISED = f"w as (select l_orderkey, l_linenumber, l_partkey, {TEXTS}[(l_partkey % 5 + 1)::integer] as text, (l_suppkey * 7 % 100)::integer as confidence, l_discount * 20 - 0.6 as x, l_quantity / 40 as size, l_tax * 12 as angle from lineitem)"


@query(f"""with {RECOGNISED} select l_orderkey, l_linenumber, l_partkey, x >= -0.5 and x < 1.5 and size > 0 and size <= 1 and angle < pi() / 4 and text <> ' ' as drawable from w
where trim(text) <> '' and (confidence >= 50 or (confidence >= 20 and regexp_matches(text, '[\\p{{L}}\\p{{N}}]')))""")
def recognised_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("word", " ", "--", "x9", "é"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    words = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", text.alias("text"), (F.col("l_suppkey") * 7 % 100).cast("int").alias("confidence"), (F.col("l_discount") * 20 - 0.6).alias("x"), (F.col("l_quantity") / 40).alias("size"), (F.col("l_tax") * 12).alias("angle"))
    drawable = reading.is_drawable(F.col("text"), F.col("x"), F.lit(0.2), F.lit(0.5), F.col("size"), F.col("angle"))
    return reading.kept_words(words).select("l_orderkey", "l_linenumber", "l_partkey", drawable.alias("drawable"))


@query("select o_orderkey as source, 1 as page_no from orders where o_orderkey not in (select l_orderkey from lineitem group by l_orderkey having sum(l_quantity::integer) >= 32)")
def pages_to_recognise(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), F.lit(1).alias("page_no"))
    glyphs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.lit(1).alias("page_no"), F.explode(F.sequence(F.lit(1), F.col("l_quantity").cast("int"))).alias("glyph_no"))
    return reading.unread_pages(pages, glyphs)


#: Orders as nodes of forms: every fourth of the next higher level is a parent.
NODES = """nodes as (select o_orderkey as id, case when o_orderkey >= 4 then o_orderkey // 4 end as parent, case when o_custkey % 3 <> 0 then 'f' || o_custkey end as name, o_custkey % 2 = 0 as is_widget,
  o_custkey % 5 = 0 as valued, case o_custkey % 15 when 0 then [''] when 5 then ['x'] else null end as value from orders)"""


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    value = F.when(c % 15 == 0, F.array(F.lit(""))).when(c % 15 == 5, F.array(F.lit("x")))
    return read(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k >= 4, F.floor(k / 4)).alias("parent"), F.when(c % 3 != 0, F.concat(F.lit("f"), c.cast("string"))).alias("name"), (c % 2 == 0).alias("is_widget"), (c % 5 == 0).alias("valued"), value.alias("value")
    )


@query(f"with {NODES} select n.id, case when n.name is not null or p.id is null then n.id else p.id end as field from nodes n left join nodes p on p.id = n.parent")
def fields_of_widgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widgets.field_of(nodes(spark, sf_dir))


@query(f"""with {NODES}, has as (select distinct parent from nodes where parent is not null)
select f.id as field, k.id as widget from nodes f join nodes k on k.parent = f.id where k.is_widget or (k.name is null and k.id not in (select parent from has)) union all select id, id from nodes where id not in (select parent from has)""")
def widgets_of_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widgets.widgets_of(nodes(spark, sf_dir))


@query(f"""with recursive {NODES}, up as (select id, id as at from nodes union all select up.id, n.parent from up join nodes n on n.id = up.at where not n.valued and n.parent is not null)
select up.id, n.valued and coalesce(n.value[1] <> '', false) as filled from up join nodes n on n.id = up.at where n.valued or n.parent is null""")
def fields_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return widgets.has_value(nodes(spark, sf_dir))


@query(f"""with recursive {NODES}, left_over as (select * from nodes where id % 7 <> 3), leaves as (select id from left_over where id not in (select parent from nodes where parent is not null)),
kept as (select id from leaves union select p.id from kept k join left_over n on n.id = k.id join left_over p on p.id = n.parent) select id from kept""")
def pruned_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = nodes(spark, sf_dir)
    return widgets.pruned(every, every.where("id % 7 = 3").select("id")).select("id")


BUTTONS = """b as (select l_orderkey as field, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::integer as widget,
  case l_partkey % 4 when 0 then ['Off', 'A'] when 1 then ['B', 'Off'] when 2 then ['Off'] end as states, l_orderkey % 3 <> 0 as is_on from lineitem)"""


@query(f"""with {BUTTONS}, c as (select field, coalesce([x for x in states if x <> 'Off'][1], 'Yes') as state from b where widget = 1)
select field, widget, case when is_on and coalesce(list_contains(states, state), widget = 1) then state else 'Off' end as shown from b join c using (field)""")
def button_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    p = F.col("l_partkey") % 4
    states = F.when(p == 0, F.array(F.lit("Off"), F.lit("A"))).when(p == 1, F.array(F.lit("B"), F.lit("Off"))).when(p == 2, F.array(F.lit("Off")))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("field"), F.row_number().over(order).alias("widget"), F.lit(1).alias("chosen"), states.alias("states"), (F.col("l_orderkey") % 3 != 0).alias("is_on"))
    return widgets.button_states(rows)


@query("""with w as (select l_orderkey as field, bool_or(l_quantity <= 5) as bare from lineitem group by all)
select o_orderkey as field, ['Tx', 'Ch', 'Btn'][(o_orderkey % 3 + 1)::integer] <> 'Btn' and (o_custkey % 10 = 0 or (o_custkey % 2 = 0 and coalesce(bare, false))) as draw from orders left join w on field = o_orderkey""")
def fields_to_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    fields = read(spark, sf_dir, "orders").select(k.alias("field"), F.element_at(F.array(*map(F.lit, ("Tx", "Ch", "Btn"))), (k % 3 + 1).cast("int")).alias("kind"), (c % 10 == 0).alias("redraws"), (c % 2 == 0).alias("filled"))
    return widgets.needs_drawing(fields, read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("field"), (F.col("l_quantity") > 5).alias("has_normal")))


@query("select o_orderkey, o_orderpriority || '=' || (case when o_custkey % 2 = 0 then 'label' else o_orderpriority end) as options from orders")
def form_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.array(F.when(F.col("o_custkey") % 2 == 0, F.array("o_orderpriority", F.lit("label"))).otherwise(F.array("o_orderpriority")))
    pairs = widgets.options(raw)
    return read(spark, sf_dir, "orders").select("o_orderkey", F.array_join(F.transform(pairs, lambda p: F.concat(p["export"], F.lit("="), p["label"])), ",").alias("options"))


#: Lines of orders as annotations on the page of their part, with a rectangle, points, both or neither.
NOTES = """a as (select l_partkey as source, 1 as page_no, row_number() over (partition by l_partkey order by l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice)::integer as id,
  ['Link', 'Widget', 'Text', 'Popup', 'Ink'][(l_suppkey % 5 + 1)::integer] as subtype, (l_orderkey % 64)::integer as flags, l_quantity > 20 as has_appearance, l_linenumber * 10.0 as l, l_discount * 500 as b,
  case when l_orderkey % 3 = 0 then 0 else 15 end as w, l_orderkey % 4 <> 1 as has_rect, l_orderkey % 5 < 2 as has_points from lineitem),
boxes as (select p_partkey as source, 1 as page_no, (p_size % 6) * 10.0 as l, 5.0 as b, (p_size % 6) * 10.0 + 12 as r, 5.0 + p_size as t from part),
met as (select a.*, (has_rect and ((least(a.l + w, x.r) > greatest(a.l, x.l) and least(a.b + w, x.t) > greatest(a.b, x.b)) or (w = 0 and a.l between x.l and x.r and a.b between x.b and x.t)))
  or (has_points and least(a.l + 30, x.r) > greatest(a.l + 20, x.l) and least(a.b + 9, x.t) > greatest(a.b, x.b)) or (not has_rect and not has_points) as under from a left join boxes x using (source, page_no))"""


def notes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    k = F.col("l_orderkey")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    l, b, w = F.col("l_linenumber") * 10.0, F.col("l_discount") * 500, F.when(k % 3 == 0, 0).otherwise(15)
    rect = F.when(k % 4 != 1, F.struct(l.alias("l"), b.alias("b"), (l + w).alias("r"), (b + w).alias("t")))
    at = lambda dx, dy: F.struct((l + dx).alias("x"), (b + dy).alias("y"))
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("source"), F.lit(1).alias("page_no"), F.row_number().over(order).alias("id"), F.element_at(F.array(*map(F.lit, ("Link", "Widget", "Text", "Popup", "Ink"))), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("subtype"),
        (k % 64).cast("int").alias("flags"), (F.col("l_quantity") > 20).alias("has_appearance"), rect.alias("rect"), F.when(k % 5 < 2, F.array(at(20, 9), at(30, 0))).otherwise(F.expr("cast(array() as array<struct<x:double,y:double>>)")).alias("points"),
    )
    left = (F.col("p_size") % 6) * F.lit(10.0)
    boxes = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.lit(1).alias("page_no"), left.cast("double").alias("l"), F.lit(5.0).alias("b"), (left + 12).cast("double").alias("r"), (F.lit(5.0) + F.col("p_size")).alias("t"))
    return rows, boxes


@query(f"with {NOTES} select source, page_no, id, (subtype = 'Widget')::integer as last from met where under")
def annotations_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotations.under(*notes(spark, sf_dir)).select("source", "page_no", "id", "last")


@query(f"with {NOTES} select source, page_no, id from met where not under and (source % 3 <> 0 or subtype = 'Link')")
def annotations_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, boxes = notes(spark, sf_dir)
    return annotations.remaining(rows, boxes, rows.where("source % 3 = 0")).select("source", "page_no", "id")


@query(f"with {NOTES} select source, page_no, array_to_string(list(id order by b, id), ',') as ids from a group by all")
def listed_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = notes(spark, sf_dir)
    everyone = read(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_partkey").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice")
    bottoms = everyone.select(F.col("l_partkey").alias("source"), F.row_number().over(order).alias("id"), (F.col("l_discount") * 500).alias("bottom"))
    placed = rows.join(bottoms, ["source", "id"]).withColumn("place", F.struct("bottom", "id"))
    return annotations.listed(placed).select("source", "page_no", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"with {NOTES} select source, id, case when has_appearance then 'draw' else 'remove' end as mark from a where flags & 34 = 0 and subtype not in ('Link', 'Popup')")
def annotation_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = notes(spark, sf_dir)
    drawn = annotations.flatten_marks(rows).select("source", "id", F.lit("draw").alias("mark"))
    return drawn.union(annotations.removal_marks(rows).select("source", "id", F.lit("remove").alias("mark")))


@query("""with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 5)::double as w, (l_suppkey % 4 + 1)::double as h, l_linenumber::double as l, l_quantity as b, (l_linenumber + 10)::double as r, l_quantity + 5 as t, (l_partkey % 32)::integer as flags, (l_suppkey % 4 * 90)::integer as rotation from lineitem),
f as (select *, w > 0 as ok, 10 / (w * 2) as sx, 5 / (h * 3) as sy from p), m as (select *, l - 1 * sx as e, b - 1 * sy as f, radians(rotation) as a, (flags & 16) = 0 or rotation = 0 as upright from f)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when ok then round(case when upright then sx else sx * cos(a) end, 5) end as a, case when ok then round(case when upright then e else e * cos(a) - f * sin(a) + l - l * cos(a) + t * sin(a) end, 5) end as e from m""")
def placed_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appearances of the box (0, 0, w, h) under (2, 0, 0, 3, 1, 1) in rectangles of lines."""
    w, h = (F.col("l_partkey") % 5).cast("double"), (F.col("l_suppkey") % 4 + 1).cast("double")
    box = F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("b"), w.alias("r"), h.alias("t"))
    n, q = F.col("l_linenumber").cast("double"), F.col("l_quantity")
    rect = F.struct(n.alias("l"), q.alias("b"), (n + 10).alias("r"), (q + 5).alias("t"))
    m = annotations.placement(box, F.array(*map(F.lit, (2.0, 0.0, 0.0, 3.0, 1.0, 1.0))), rect, (F.col("l_partkey") % 32).cast("int"), (F.col("l_suppkey") % 4 * 90).cast("int"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", m.alias("m")).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("m")[0], 5).alias("a"), F.round(F.col("m")[4], 5).alias("e"))


@query("select o_orderkey, case when o_custkey % 3 = 0 then 'stream' when o_custkey % 3 = 1 then 'on' end as state from orders")
def appearance_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey") % 3
    states = F.create_map(F.lit("Yes"), F.lit("on"), F.lit("Off"), F.lit("off"))
    return read(spark, sf_dir, "orders").select("o_orderkey", annotations.chosen_state(F.when(c == 0, "stream"), states, F.when(c == 1, "Yes").otherwise("Other")).alias("state"))


KINDS = ("markup", "ink", "shape", "line", "text", "note", "image")


@query("""with a as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, ['markup', 'ink', 'shape', 'line', 'text', 'note', 'image'][(l_partkey % 7 + 1)::integer] as kind, l_discount * 12 as x, l_tax * 12 as y, l_quantity / 40 as x1, 0.9::double as y1, l_suppkey % 11 / 10.0 as opacity,
  case when l_suppkey % 3 = 0 then ' ' else 'words' end as text, l_linenumber % 2 = 0 as flatten, l_quantity - 5 as width, l_extendedprice % 7 / 6.5 as tint from lineitem),
f as (select *, x between 0 and 1 and y between 0 and 1 and x1 between 0 and 1 as inside, x < x1 and y < y1 as area, width between 0.1 and 100 as pen from a)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, case when not tint between 0 and 1 then 'no valid color' when not (opacity > 0 and opacity <= 1) then 'no valid opacity' when kind = 'text' and trim(text) = '' then 'an empty text box'
  when kind = 'note' and flatten then 'a note can''t be drawn' when kind = 'note' and trim(text) = '' then 'an empty note'
  when not (case kind when 'markup' then inside and area when 'shape' then inside and area and pen when 'ink' then inside and pen when 'line' then inside and pen and (x <> x1 or y <> y1) when 'text' then inside and area when 'note' then inside
    else x between 0 and 1 and y between 0 and 1 and width > 0 and width <= 1 end) then 'not on the page' end as problem from f""")
def annotation_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    points = F.array(at(F.col("l_discount") * 12, F.col("l_tax") * 12), at(F.col("l_quantity") / 40, F.lit(0.9)))
    rows = read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.element_at(F.array(*map(F.lit, KINDS)), (F.col("l_partkey") % 7 + 1).cast("int")).alias("kind"), points.alias("points"), ((F.col("l_suppkey") % 11) / 10.0).alias("opacity"),
        F.when(F.col("l_suppkey") % 3 == 0, " ").otherwise("words").alias("text"), (F.col("l_linenumber") % 2 == 0).alias("flatten"), (F.col("l_quantity") - 5).alias("width"), F.array(F.col("l_extendedprice") % 7 / 6.5).alias("color"), F.lit(12.0).alias("size"),
    )
    return annotations.problem(rows).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "problem")


@query("""with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount as x0, l_tax as y0, l_quantity / 100 as x1, 0.4::double as y1, 0.3::double as x2, l_linenumber / 10.0 as y2 from lineitem),
e as (select *, least(x0, x1, x2) as l, least(y0, y1, y2) as t, greatest(x0, x1, x2) as r, greatest(y0, y1, y2) as b from p), c as (select *, (l + r) / 2 as cx, (t + b) / 2 as cy, (r - l) as hw, (b - t) as hh from e),
f as (select *, least(case when hw > 0 then least(cx, 1 - cx) / hw else 1e9 end, case when hh > 0 then least(cy, 1 - cy) / hh else 1e9 end, 1) as fits from c)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(case when fits < 1 then x0 else cx - hw + (x0 - l) / (r - l) * 2 * hw end, 6) as x, round((x1 + x2) / 2, 6) as middle, 7::bigint as numbers from f""")
def scaled_strokes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strokes of three points: twice as large where that fits, smoothed, and packed."""
    at = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    points = F.array(at(F.col("l_discount"), F.col("l_tax")), at(F.col("l_quantity") / 100, F.lit(0.4)), at(F.lit(0.3), F.col("l_linenumber") / 10.0))
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", points.alias("ps"))
    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(annotations.scaled(F.col("ps"), 2.0)[0]["x"], 6).alias("x"), F.round(annotations.smoothed(F.col("ps"))[0]["x"], 6).alias("middle"),
        F.size(annotations.packed_strokes(F.array("ps"))).cast("long").alias("numbers"),
    )


PIXELS = "p as (select l_returnflag as page, (l_partkey % 256)::integer as r, (l_suppkey % 64)::integer as g, l_linenumber::integer as b from lineitem)"


@query(f"""with {PIXELS}, c as (select page, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) as bucket, count(*) as n, round(avg(r), 4) as red, round(avg(g), 4) as green, round(avg(b), 4) as blue from p group by all),
paper as (select * from (select *, row_number() over (partition by page order by n desc, bucket) as k from c) where k = 1),
d as (select p.*, red, green, blue, sqrt((r - red) * (r - red) + (g - green) * (g - green) + (b - blue) * (b - blue)) as away from p join paper using (page)), f as (select page, max(away) as far from d group by page)
select page, any_value(red) as red, floor(avg(r) + 0.5)::integer as ink_red, floor(avg(g) + 0.5)::integer as ink_green, floor(avg(b) + 0.5)::integer as ink_blue from d join f using (page) where far >= 40 and away >= far * 0.8 group by page""")
def ink_and_paper_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("page"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 64).cast("int").alias("g"), F.col("l_linenumber").cast("int").alias("b"))
    return annotations.ink_and_paper(pixels, ["page"]).select("page", "red", "ink_red", "ink_green", "ink_blue")


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, floor((l_suppkey % 256) * least(greatest((225 - least(l_partkey % 256, 150 + l_linenumber * 15, 240)) / 60.0, 0), 1) + 0.5)::integer as alpha from lineitem")
def faded_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    alpha = annotations.ink_alpha(F.col("l_partkey") % 256, (150 + F.col("l_linenumber") * 15).cast("long"), F.lit(240).cast("long"), F.col("l_suppkey") % 256)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", alpha.alias("alpha"))
