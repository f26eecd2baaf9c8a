"""Queries of pixels, of files that lost something, of small rules: lines of orders as pixels and shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import codecs, fonts
from foliant.functions import text as T
from foliant.operators import annotations, compare, pixels, style, workspace
from foliant.registry import query, read
from foliant.sources import pdf

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEYS = ", ".join(KEY)
#: A picture for each return flag, with a slope and an angle for its pixels.
SLOPES = "p as (select l_returnflag as image, (l_partkey % 60)::integer as x, (l_suppkey % 40)::integer as y, max(l_quantity * 4)::double as slope, max(l_linenumber * 25)::integer as angle from lineitem group by all)"


def slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("image"), (F.col("l_partkey") % 60).cast("int").alias("x"), (F.col("l_suppkey") % 40).cast("int").alias("y"), (F.col("l_quantity") * 4).alias("slope"), (F.col("l_linenumber") * 25).cast("int").alias("angle"))
    return rows.groupBy("image", "x", "y").agg(F.max("slope").alias("slope"), F.max("angle").alias("angle"))


EDGES = f"""{SLOPES}, o as (select image, slope, row_number() over (partition by image order by slope) - 1 as k, count(*) over (partition by image) as n from p where slope > 0),
t as (select image, greatest(least(slope, 240), 40) as strong from o where k = n * 90 // 100), w as (select p.*, strong from p join t using (image) where slope >= strong * 0.4),
e as (select image, x, y from w where slope >= strong union select w.image, w.x, w.y from e join w on w.image = e.image and abs(w.x - e.x) <= 1 and abs(w.y - e.y) <= 1)"""


@query(f"with recursive {EDGES} select image, x, y from e")
def edge_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.edges(slopes(spark, sf_dir).select("image", "x", "y", "slope"))


VOTES = f"""{SLOPES}, v as (select image, x, y, ((unnest(generate_series(angle - 6, angle + 6)) % 180 + 180) % 180)::integer as theta from p),
c as (select image, theta, floor(x * cos(radians(theta)) + y * sin(radians(theta)) + 0.5)::bigint as rho, count(*) as votes from v group by all)"""


@query(f"with {VOTES} select image, theta, rho, votes from c where abs(theta - 90) > 0")
def line_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.votes(slopes(spark, sf_dir)).where("theta <> 90").select("image", "theta", "rho", "votes")


@query(f"with {VOTES}, r as (select *, row_number() over (partition by image order by votes desc, theta, rho) as k from c) select image, theta::bigint as theta, rho, votes from r where k = 1")
def strongest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.strongest_lines(pixels.votes(slopes(spark, sf_dir)), 1, 1)


@query(f"""with {SLOPES}, s as (select o_orderkey as segment, ['A', 'N', 'R'][(o_orderkey % 3 + 1)::integer] as image, o_custkey % 50 as x0, o_orderkey % 30 as y0, o_orderkey % 60 as x1, o_custkey % 40 as y1 from orders),
n as (select *, greatest(abs(x1 - x0), abs(y1 - y0), 1)::integer as n from s), i as (select *, unnest(generate_series(0, n)) as i from n),
q as (select image, segment, floor(x0 + (x1 - x0) * i / n::double + 0.5)::integer as x, floor(y0 + (y1 - y0) * i / n::double + 0.5)::integer as y from i)
select q.image, segment, round(count(p.x) / count(*), 6) as share from q left join p on p.image = q.image and p.x = q.x and p.y = q.y and p.slope >= 100 group by all""")
def segment_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    segments = read(spark, sf_dir, "orders").select(k.alias("segment"), F.element_at(F.array(*map(F.lit, "ANR")), (k % 3 + 1).cast("int")).alias("image"), (c % 50).alias("x0"), (k % 30).alias("y0"), (k % 60).alias("x1"), (c % 40).alias("y1"))
    return pixels.support(segments, slopes(spark, sf_dir).where("slope >= 100")).withColumn("share", F.round("share", 6))


@query(f"""with q as (select {KEYS}, 0.0::double as x0, 0.0::double as y0, 100.0 + l_quantity as x1, 5.0::double as y1, 90.0::double + l_linenumber as x2, 120.0 + l_quantity as y2, -3.0::double as x3, 110.0::double as y3, l_discount * 9 as u, l_tax * 11 as v from lineitem),
d as (select *, x1 - x2 as dx1, x3 - x2 as dx2, x0 - x1 + x2 - x3 as sx, y1 - y2 as dy1, y3 - y2 as dy2, y0 - y1 + y2 - y3 as sy from q), e as (select *, dx1 * dy2 - dx2 * dy1 as det from d), g as (select *, (sx * dy2 - dx2 * sy) / det as g, (dx1 * sy - sx * dy1) / det as h from e)
select {KEYS}, round(((x1 - x0 + g * x1) * u + (x3 - x0 + h * x3) * v + x0) / (g * u + h * v + 1), 5) as x, round(((y1 - y0 + g * y1) * u + (y3 - y0 + h * y3) * v + y0) / (g * u + h * v + 1), 5) as y from g""")
def points_in_perspective(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    corner = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    quad = F.array(corner(F.lit(0.0), F.lit(0.0)), corner(100.0 + q, F.lit(5.0)), corner(90.0 + n, 120.0 + q), corner(F.lit(-3.0), F.lit(110.0)))
    at = pixels.quad_point(quad, F.col("l_discount") * 9, F.col("l_tax") * 11)
    return read(spark, sf_dir, "lineitem").select(*KEY, at.alias("p")).select(*KEY, F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


COVERED = """i as (select p_partkey as image, p_partkey % 50 as page, (p_size % 5)::double as l, (p_size % 3)::double as t, (p_size % 5 + 20)::double as r, (p_size % 3 + 10)::double as b, 40 as columns, 20 as rows from part),
x as (select s_suppkey % 50 as page, (s_suppkey % 15)::double as bl, (s_suppkey % 7)::double as bt, (s_suppkey % 15 + 6.3)::double as br, (s_suppkey % 7 + 2.2)::double as bb from supplier),
m as (select image, greatest(ceil((bl - l) / 0.5 - 0.1), 0)::integer as first, least(floor((br - l) / 0.5 + 0.1), 40)::integer - 1 as last, greatest(ceil((bt - t) / 0.5 - 0.1), 0)::integer as top, least(floor((bb - t) / 0.5 + 0.1), 20)::integer - 1 as bottom from i join x using (page)),
s as (select image, unnest(generate_series(top, bottom))::integer as row, first, last from m where first <= last and top <= bottom)"""


def images_and_boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, s = F.col("p_size"), F.col("s_suppkey")
    d = lambda c: c.cast("double")
    images = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("image"), (F.col("p_partkey") % 50).alias("page"), d(p % 5).alias("l"), d(p % 3).alias("t"), d(p % 5 + 20).alias("r"), d(p % 3 + 10).alias("b"), F.lit(40).alias("columns"), F.lit(20).alias("rows"))
    boxes = read(spark, sf_dir, "supplier").select((s % 50).alias("page"), d(s % 15).alias("l"), d(s % 7).alias("t"), d(s % 15 + 6.3).alias("r"), d(s % 7 + 2.2).alias("b"))
    return images, boxes


@query(f"with {COVERED} select image, row, first, last from s")
def covered_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.covered_spans(*images_and_boxes(spark, sf_dir))


@query(f"""with {COVERED}, p as (select l_partkey as image, (l_suppkey % 40)::integer as x, l_linenumber::integer as y, max(l_quantity)::integer as value from lineitem group by all)
select image, x, y, case when exists (select 1 from s where s.image = p.image and s.row = p.y and p.x between s.first and s.last) then 255 else value end as value from p""")
def painted_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("image"), (F.col("l_suppkey") % 40).cast("int").alias("x"), F.col("l_linenumber").cast("int").alias("y"), F.col("l_quantity").cast("int").alias("value"))
    return pixels.redacted_under(rows.groupBy("image", "x", "y").agg(F.max("value").alias("value")), *images_and_boxes(spark, sf_dir), 255)


@query("select doc_id, case doc_id % 4 when 1 then 'stream 4 has no length' when 2 then 'stream 4 has a wrong length' when 3 then 'object 3 is missing' end as loss, greatest(1, ((len(string_split(text, chr(10))) + 49) // 50))::integer as condition from documents")
def lost_in_loading(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as PDF files that are damaged each in one way, what is lost, and the pages that are left."""
    lines = F.split("text", "\n")
    n = F.ceil(F.size(lines) / 50).cast("int")
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(lines, i * 50 + 1, F.lit(50)), "\n"))).alias("pos", "part"))
    pages = parts.select(F.col("doc_id").alias("out"), "pos", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotate"), pdf.drawn("part").alias("content"))
    hexed = F.hex("file")
    sign = lambda t: t.encode().hex().upper()
    way = F.col("out") % 4
    first = lambda old, new: F.regexp_replace(hexed, f"^((?:..)*?){sign(old)}", f"$1{sign(new)}")
    damaged = F.when(way == 1, first("/Length ", "/Lengxh ")).when(way == 2, first("/Length ", "/Length 9")).when(way == 3, first("\n3 0 obj", "\n99999 0 obj")).otherwise(hexed)
    files = pdf.write_files(pages).select(F.col("out").cast("string").alias("path"), F.unhex(damaged).alias("content"))
    held = pdf.conditions(pdf.read_pages(files))
    return files.join(held, "path").select(F.col("path").cast("long").alias("doc_id"), pdf.load_losses("content").alias("loss"), "condition")


@query("select doc_id, length(replace(text, chr(10), ''))::bigint as glyphs, md5(replace(text, chr(10), '')) as digest from documents")
def packed_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of documents written as PDF files whose objects are packed in streams."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("out"), F.lit(0).alias("pos"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotate"), pdf.drawn("text").alias("content"))
    files = pdf.write_files(docs, True).select(F.col("out").cast("string").alias("path"), F.col("file").alias("content"))
    found = pdf.page_texts(pdf.read_pages(files))
    return found.select(F.col("path").cast("long").alias("doc_id"), F.length("text").cast("long").alias("glyphs"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""with l as (select doc_id, string_split(text, chr(10)) as ls from documents), u as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as k from l)
select doc_id, (k - 1)::integer as line_no, round(72 + 7.2 * length(line), 4) as ends, round(720 - 14.4 * (k - 1), 4) as baseline from u where line <> ''""")
def pdf_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the lines of documents end on their pages: every character of their font is as wide as any other."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("out"), F.lit(0).alias("pos"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotate"), pdf.drawn("text").alias("content"))
    files = pdf.write_files(docs).select(F.col("out").cast("string").alias("path"), F.col("file").alias("content"))
    glyphs = pdf.read_glyphs(pdf.read_pages(files))
    baseline = (1 - F.col("b")) * 792
    rows = glyphs.groupBy(F.col("source").cast("long").alias("doc_id"), F.floor((720 - baseline) / 14.4 + 0.5).cast("int").alias("line_no")).agg(F.round(F.max(F.col("r") * 612), 4).alias("ends"), F.round(F.max(baseline), 4).alias("baseline"))
    return rows


@query("select o_orderkey, 'D2:K8:' || 'Priority' || 'S' || length(o_orderpriority) || ':' || o_orderpriority || 'K6:StatusS1:' || o_orderstatus as canonical, 'Type,Page,' || o_orderstatus as names, '{\"a\":' || o_custkey || ',\"b\":\"' || o_orderstatus || '\"}' as signature from orders")
def canonical_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.create_map(F.lit("Status"), F.col("o_orderstatus"), F.lit("Priority"), F.col("o_orderpriority"))
    text = F.concat(F.lit("<< /Type /Page /"), F.col("o_orderstatus"), F.lit(" 1 /Type [/Page] >>"))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", T.canonical(entries).alias("canonical"), F.array_join(T.names_in(text), ",").alias("names"), workspace.signature(F.col("o_custkey").alias("a"), F.col("o_orderstatus").alias("b")).alias("signature")
    )


@query("""select p_partkey, ['japanese', 'korean', 'japanese,korean', 'simplified', 'traditional', 'japanese', ''][(p_partkey % 7 + 1)::integer] as faces, ['東', '한', 'か', '東', '東', '東', 'Ж'][(p_partkey % 7 + 1)::integer] as lacks,
['a-' || p_name, null, p_name][(p_partkey % 3 + 1)::integer] as generated, case when p_partkey % 2 = 0 then p_name end as line from part""")
def scripts_and_generated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))
    text = pick(("東か", "한 x", "か한", "東京", "東京", "東京", "abcЖ"))
    language = pick(("en", "en", "en", "en", "zh-TW", "ja-JP", "en"))
    content = pick(("'a-' attr( title )", "url(x.png)", '"" attr(title)'))
    item = F.concat(F.lit("<li> <b>\n</b>"), F.when(k % 2 == 0, F.concat(F.lit("<i>"), F.col("p_name"), F.lit("</i> more"))).otherwise(""), F.lit("<ul><li>inner</li></ul></li>"))
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.array_join(fonts.east_asian_faces(text, language), ",").alias("faces"), fonts.first_uncovered(text, ["[α-ω]"]).alias("lacks"),
        style.generated_text(content, F.create_map(F.lit("title"), F.col("p_name"))).alias("generated"), style.first_line(item).alias("line"),
    )


@query("""with c as (select conv_id, turn, unnest(string_split(text, '')) as c, generate_subscripts(string_split(text, ''), 1) as k from conversations), p as (select conv_id as key, turn * 1000000 + k as pos, c as word from c where c <> ''),
f as (select key, word, min(pos) as first from p group by all), i as (select key, word, row_number() over (partition by key order by first) - 1 as id from f) select key, word, id from i""")
def character_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of the characters of an invisible text layer, by first appearance."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "")).alias("k", "c")).where("c <> ''")
    rows = turns.select(F.col("conv_id").alias("key"), F.lit(0).alias("side"), (F.col("turn") * F.lit(1000000) + F.col("k")).alias("pos"), F.col("c").alias("word"))
    return compare.codes(rows)


@query(f"with s as (select {KEYS}, l_discount as l, l_tax as t, l_quantity / 100 as w from lineitem) select {KEYS}, round(l * 600, 5) as l, round(800 - t * 800 - w * 600 * 0.5, 5) as b, round(l * 600 + w * 600, 5) as r from s")
def signature_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    box = annotations.signature_box(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 100, F.lit(600.0), F.lit(800.0), F.lit(0.5))
    return read(spark, sf_dir, "lineitem").select(*KEY, box.alias("x")).select(*KEY, F.round("x.l", 5).alias("l"), F.round("x.b", 5).alias("b"), F.round("x.r", 5).alias("r"))


@query("""select o_orderkey as id, case when o_custkey % 3 = 0 then 'own' else 'on' end as stream, round(10.0 / (o_custkey % 4), 5) as scale from orders where o_custkey % 64 & 34 = 0 and o_orderkey % 5 <> 0 and o_custkey % 4 <> 0 and (o_custkey % 3 = 0 or o_orderkey % 2 = 0)""")
def drawable_appearances(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    box = lambda w: F.struct(F.lit(0.0).alias("l"), F.lit(0.0).alias("b"), w.alias("r"), F.lit(5.0).alias("t"))
    rows = read(spark, sf_dir, "orders").select(
        k.alias("id"), F.when(k % 5 == 0, "Popup").otherwise("Stamp").alias("subtype"), (c % 64).cast("int").alias("flags"), F.when(c % 3 == 0, "own").alias("stream"), F.create_map(F.lit("Yes"), F.lit("on")).alias("states"),
        F.when(k % 2 == 0, "Yes").otherwise("Off").alias("state"), box((c % 4).cast("double")).alias("box"), F.array(*map(F.lit, (1.0, 0.0, 0.0, 1.0, 0.0, 0.0))).alias("form_matrix"), box(F.lit(10.0)).alias("rect"), F.lit(0).alias("rotation"),
    )
    return annotations.appearances(rows).select("id", "stream", F.round(F.col("matrix")[0], 5).alias("scale"))


@query("select o_orderkey as mark, case when o_orderkey % 3 = 0 then 'S' else 'Alt,S' end as keys from orders")
def undescribed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "orders").select(F.lit("f").alias("source"), F.lit(1).alias("page_no"), F.col("o_orderkey").alias("mark"), F.create_map(F.lit("Alt"), F.lit("a"), F.lit("S"), F.lit("P")).alias("entries"))
    out = annotations.undescribed(rows, rows.where("mark % 3 = 0"))
    return out.select("mark", F.array_join(F.array_sort(F.map_keys("entries")), ",").alias("keys"))


@query("select doc_id as id, md5(text) as digest, case when doc_id % 3 = 0 then 'Length' else 'Length,Thumb' end as keys, true as fits from documents where doc_id % 4 <> 1")
def compressed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    streams = read(spark, sf_dir, "documents").select(
        F.lit("f").alias("source"), k.alias("id"), F.when(k % 4 == 1, "metadata").otherwise("page").alias("kind"),
        F.create_map(F.lit("Length"), F.lit(1), F.when(k % 3 == 0, "Metadata").otherwise("Thumb"), F.lit(2)).alias("entries"), F.col("text").cast("binary").alias("data"), F.length(F.col("text").cast("binary")).alias("size"),
    )
    out = workspace.compressed(streams, thumbnails=False)
    plain = F.when(F.length("data") < F.col("size"), codecs.inflated("data")).otherwise(F.col("data"))
    return out.select("id", F.md5(plain).alias("digest"), F.array_join(F.array_sort(F.map_keys("entries")), ",").alias("keys"), (F.length("data") <= F.col("size")).alias("fits"))
