"""Queries of styles, files and texts through models: parts, orders and documents stand for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import retrieval, style, workspace
from foliant.registry import query, read

KEY = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
KEYS = ", ".join(KEY)
STACKS = ("'Fira Code', serif", "Georgia", "\"Open Sans\", serif", "serif", "Arial", "Times New Roman", "monospace")
MEDIA = ("print", "screen and (min-width: 9px)", "not print, all", "only screen", "", "NOT screen and (color), print and (x)", "tv")
COLORS = ("#fff", "#0a0B0c", "rgb(1, 2, 3)", "rgba(10,20,30,0.5)", "#11223380", "red", "#12")


def pick(values: tuple, at):
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


@query("""select p_partkey, ['courier', 'times', 'helvetica', 'times', 'helvetica', 'times', 'courier'][(p_partkey % 7 + 1)::integer] as family,
['all', 'not all', 'not all, all', 'not all', '', 'all and (color), all and (x)', 'tv'][(p_partkey % 7 + 1)::integer] as media,
[[255, 255, 255, 1], [10, 11, 12, 1], [1, 2, 3, 1], [10, 20, 30, 0.5], [17, 34, 51, 128 / 255.0], null, null][(p_partkey % 7 + 1)::integer][1]::double as red, round([[1.0], [1.0], [1.0], [0.5], [128 / 255.0], null, null][(p_partkey % 7 + 1)::integer][1]::double, 6) as alpha,
case p_partkey % 4 when 0 then upper(p_name || '-x y.z') when 1 then lower(p_type) when 2 then array_to_string([upper(w[1]) || w[2:] for w in string_split(p_name, ' ')], ' ') || '-X Y.Z' else p_name || '-x y.z' end as cased from part""")
def styles(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    rgba = style.color(pick(COLORS, k))
    name = F.when(k % 4 == 1, F.col("p_type")).otherwise(F.concat("p_name", F.lit("-x y.z")))
    return read(spark, sf_dir, "part").select(
        "p_partkey", style.family_class(pick(STACKS, k)).alias("family"), style.print_media(pick(MEDIA, k)).alias("media"), rgba[0].alias("red"), F.round(rgba[3], 6).alias("alpha"),
        style.letter_case(name, pick(("uppercase", "lowercase", "capitalize", "none"), k)).alias("cased"),
    )


@query("""select o_orderkey, case when o_custkey = 0 then '0 KB' when o_custkey * 700 < 1048576 then greatest(1, floor(o_custkey * 700 / 1024.0 + 0.5))::bigint || ' KB' else printf('%.1f', floor(o_custkey * 700 / 1048576.0 * 10 + 0.5) / 10) || ' MB' end as size from orders""")
def sizes_in_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", style.size_text(F.col("o_custkey") * 700).alias("size"))


@query(f"""with b as (select *, (l_partkey % 2000)::double as l, l_quantity as t, (l_partkey % 2000)::double + 300 as r, l_quantity + 100 as b, l_linenumber::double as border, l_suppkey % 2 = 0 as hx, l_suppkey % 3 = 0 as hy, l_suppkey % 5 as op from lineitem),
p as (select *, greatest(0, floor((l + 10) / 500))::integer as page from b)
select {KEYS}, page, greatest(case when hx then l + border else -1e6 end, case when op = page then 100.0 else -1e6 end, page * 500.0 - 10) as cl, least(case when hy then b - border else 1e6 end, case when op = page then 90.0 else 1e6 end, 800.0) as cb from p""")
def clipped_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, t = (F.col("l_partkey") % 2000).cast("double"), F.col("l_quantity")
    outer = F.struct(F.lit(100.0).alias("l"), F.lit(0.0).alias("t"), F.lit(400.0).alias("r"), F.lit(90.0).alias("b"))
    s = F.col("l_suppkey")
    boxes = read(spark, sf_dir, "lineitem").select(*KEY, l.alias("l"), t.alias("t"), (l + 300).alias("r"), (t + 100).alias("b"), F.col("l_linenumber").cast("double").alias("border"), (s % 2 == 0).alias("hides_x"), (s % 3 == 0).alias("hides_y"), (s % 5).cast("int").alias("outer_page"), outer.alias("outer"))
    out = style.clips(boxes, 20.0, 500.0, 480.0, 760.0, 40.0)
    return out.select(*KEY, "page", F.col("clip.l").alias("cl"), F.col("clip.b").alias("cb"))


@query("""with b as (select o_orderkey as key, o_custkey % 3 as a, case when o_orderkey % 2 = 0 then o_custkey % 3 else 1 end as c from orders), s as (select key, unnest(['top', 'right', 'bottom', 'left']) as side, unnest([a, c, a, c])::integer as width, a = c as alike from b)
select key, case when alike then 'outline' else side end as side, width, 'black' as color from s where width > 0 and (not alike or side = 'top')""")
def drawn_borders(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = (F.col("o_custkey") % 3).cast("int")
    c = F.when(F.col("o_orderkey") % 2 == 0, a).otherwise(1)
    side = lambda w: F.struct(w.alias("width"), F.lit("black").alias("color"))
    return style.borders(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.array(side(a), side(c), side(a), side(c)).alias("sides")))


@query("select distinct ['courier', 'times', 'helvetica', 'times', 'helvetica', 'times', 'courier'][(p_partkey % 7 + 1)::integer] as family, p_size * 20 >= 600 as bold from part")
def fonts_in_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    return style.used_fonts(read(spark, sf_dir, "part").select(pick(STACKS, F.col("p_partkey")).alias("stack"), (F.col("p_size") * 20).alias("weight")))


@query("""with u as (select l_orderkey as page, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::integer as pos, l_returnflag || l_linestatus as key from lineitem),
f as (select page, key, min(pos) as first from u group by all), n as (select page, key, (row_number() over (partition by page order by first) - 1)::integer as image from f) select page, pos, key, image from u join n using (page, key)""")
def stored_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return style.numbered_images(read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), F.row_number().over(order).alias("pos"), F.concat("l_returnflag", "l_linestatus").alias("key")))


@query("""with f as (select o_custkey as job, row_number() over (partition by o_custkey order by o_orderkey)::integer - 1 as pos, o_orderkey from orders)
select job, o_orderkey, case when pos = 1 then 3 when pos between 2 and 3 then pos - 1 else pos end as pos, md5('f' || o_orderkey || chr(1) || pos || chr(1) || 7) as key from f""")
def reordered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    files = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), (F.row_number().over(order) - 1).alias("pos"), "o_orderkey")
    key = workspace.source_key(F.concat(F.lit("f"), F.col("o_orderkey").cast("string")), F.col("pos"), F.lit(7))
    files = files.withColumn("key", F.md5(F.translate(key, "\0", "\1").cast("binary")))
    return workspace.moved(files, 1, 3)


@query("""with p as (select l_orderkey as source, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::integer as page_no from lineitem)
select source, page_no, (row_number() over (partition by source order by abs(page_no - 3), page_no) - 1)::integer as turn from p""")
def nearest_pages_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.row_number().over(order).alias("page_no"))
    return workspace.nearest_first(rows, 3)


@query("select o_custkey as job, count(*) filter (where o_orderpriority not like '1%' and o_orderpriority not like '2%')::bigint as skipped, count(*) filter (where o_orderpriority like '1%' or o_orderpriority like '2%')::bigint as taken from orders group by o_custkey")
def accepted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("job"), F.concat(F.lit("a.b."), F.substring("o_orderpriority", 1, 1)).alias("name"))
    taken, skipped = workspace.accepted(files, ["1", "2"])
    return skipped.join(taken.groupBy("job").agg(F.count("*").alias("taken")), "job", "left").select("job", "skipped", F.coalesce("taken", F.lit(0)).alias("taken"))


@query("select p_type as pair, sum(p_size)::bigint as size, count(*) as parts from part group by p_type")
def sizes_of_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workspace.total_sizes(read(spark, sf_dir, "part").select(F.col("p_type").alias("pair"), F.col("p_size").alias("size")), "pair")


ENTRIES = ("Metadata", "XFA", "A", "OpenAction", "Title", "Interpolate", "AA")
PLACES = ("form", "catalog", "image", "annotation", "page")


@query("""with e as (select l_orderkey as object, l_linenumber, l_partkey, l_suppkey, ['form', 'catalog', 'image', 'annotation', 'page'][(l_partkey % 5 + 1)::integer] as kind, ['Metadata', 'XFA', 'A', 'OpenAction', 'Title', 'Interpolate', 'AA'][(l_suppkey % 7 + 1)::integer] as key from lineitem)
select object, l_linenumber, l_partkey, l_suppkey, kind, key from e where not (key in ('Metadata', 'AA') or (kind = 'form' and key = 'XFA') or (kind = 'annotation' and key = 'A') or (kind = 'catalog' and key = 'OpenAction') or (kind = 'image' and key = 'Interpolate'))""")
def archived_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("object"), "l_linenumber", "l_partkey", "l_suppkey", pick(PLACES, F.col("l_partkey")).alias("kind"), pick(ENTRIES, F.col("l_suppkey")).alias("key"))
    return workspace.cleaned_entries(rows)


@query("select l_orderkey as source, array_to_string(list_sort(list(distinct l_partkey)), ',') as files from lineitem where l_returnflag = 'R' group by l_orderkey")
def attached_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("id"), (F.col("l_returnflag") == "R").alias("holds_file"))
    return workspace.attachments(held).select("source", F.array_join(F.col("files").cast("array<string>"), ",").alias("files"))


@query("""select o_orderkey, '<pdfaid:part>2</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance>' || case when o_custkey % 3 <> 0 then '<dc:title>A &amp; ' || o_orderpriority || '</dc:title>' else '' end || case when o_custkey % 2 = 0 then '<xmp:CreateDate>2024-05</xmp:CreateDate>' else '' end as packet,
case when o_custkey % 2 = 0 then 'Pages' else 'Pages,Thumb' end as keys from orders""")
def metadata_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("o_custkey")
    title = F.when(c % 3 == 0, " ").otherwise(F.concat(F.lit("A & "), "o_orderpriority"))
    info = F.create_map(F.lit("Title"), title, F.lit("CreationDate"), F.when(c % 2 == 0, "D:202405").otherwise("yesterday"))
    page = F.when(c % 2 == 0, F.create_map(F.lit("Pages"), F.lit(1), F.lit("Metadata"), F.lit(2))).otherwise(F.create_map(F.lit("Pages"), F.lit(1), F.lit("Thumb"), F.lit(3)))
    return read(spark, sf_dir, "orders").select("o_orderkey", workspace.metadata(info, 2).alias("packet"), F.array_join(F.map_keys(workspace.stripped(page, "Metadata")), ",").alias("keys"))


@query("""with o as (select l_suppkey as source, l_orderkey as id from lineitem group by all), m as (select source, max(id) as most from o group by source), s as (select source, coalesce(sum(most) over (order by source desc rows between unbounded preceding and 1 preceding), 0) as shift from m)
select o.source, (id + shift)::bigint as id, (id * 3 + shift)::bigint as dst from o join s using (source)""")
def assembled_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as files, the last one first, and the orders of each as objects that refer to three times their number."""
    objects = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_orderkey").alias("id")).distinct()
    refs = objects.select("source", F.col("id").alias("src"), (F.col("id") * 3).alias("dst"))
    sources = objects.select("source").distinct().withColumn("pos", -F.col("source"))
    kept, moved = workspace.assembled(objects, refs, sources)
    return kept.join(moved, [kept.source == moved.source, kept.id == moved.src]).select(kept.source, "id", "dst")


@query("""with f as (select l_orderkey as source, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::integer as page_no from lineitem), r as (select *, source % 4 * 90 as rotate from f)
select row_number() over (order by 1000000 - source, page_no) as out_no, source, page_no, rotate::integer as rotate from r where source % 2 = 0""")
def assembled_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    k = F.col("l_orderkey")
    frames = read(spark, sf_dir, "lineitem").select(k.alias("source"), F.row_number().over(order).alias("page_no"), (k % 4 * 90).cast("int").alias("rotate"))
    sources = frames.select("source").distinct().where("source % 2 = 0").withColumn("pos", 1_000_000 - F.col("source"))
    return workspace.assembled_pages(frames, sources)


@query("""with l as (select doc_id, lang, ['en', 'de', 'es', 'fr', null][(doc_id % 5 + 1)::integer] as target from documents)
select doc_id, case when target is null or lang = target then '' when lang = 'en' or target = 'en' then lang || '-' || target else lang || '-en,en-' || target end as models from l""")
def models_to_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", "es", "fr", None)]), (F.col("doc_id") % 5 + 1).cast("int"))
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(workspace.model_pairs(F.col("lang"), target), ",").alias("models"))


PARS = """lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as par_no from documents),
pars as (select doc_id, par_no::integer as par_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) as text from lines)"""


@query(f"with {PARS} select doc_id, par_no, case when lower(replace(replace(text, 'th', 'z'), 'z', 'y')) <> lower(text) then md5(replace(replace(text, 'th', 'z'), 'z', 'y')) end as digest from pars")
def translated_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs through two models that stand in for languages, one after the other."""
    models = {"de-en": lambda t: F.replace(t, F.lit("th"), F.lit("z")), "en-fr": lambda t: F.replace(t, F.lit("z"), F.lit("y"))}
    blocks = retrieval.paragraphs(read(spark, sf_dir, "documents")).select("doc_id", "par_no", "text")
    out = workspace.pivoted(blocks, models, "de", "fr")
    return out.select("doc_id", "par_no", F.md5(F.col("translation").cast("binary")).alias("digest"))


@query("""with b as (select l_partkey as page, l_returnflag as family, l_linestatus = 'O' as bold, l_linenumber + 5.0 as size, case when l_quantity > 10 then (l_linenumber + 5.0) * (0.6 + l_discount * 4) end as fitted, l_orderkey, l_suppkey from lineitem),
s as (select *, floor(size * 2 + 0.5) as half, fitted / size as share from b), r as (select *, row_number() over (partition by page, family, bold, half order by share) - 1 as k, count(*) over (partition by page, family, bold, half) as n from s where fitted is not null),
m as (select page, family, bold, half, share as median, n from r where k = n // 2)
select s.page, s.l_orderkey, s.l_suppkey, s.size::double as size, round(case when n >= 2 and fitted > size * median + 0.01 then size * median else fitted end, 6) as shown from s left join m using (page, family, bold, half)""")
def sizes_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("l_linenumber") + F.lit(5.0)
    blocks = read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("page"), F.col("l_returnflag").alias("family"), (F.col("l_linestatus") == "O").alias("bold"), size.alias("size"), F.when(F.col("l_quantity") > 10, size * (0.6 + F.col("l_discount") * 4)).alias("fitted"), "l_orderkey", "l_suppkey")
    return workspace.even_sizes(blocks).select("page", "l_orderkey", "l_suppkey", "size", F.round("shown", 6).alias("shown"))


@query(f"""with g as (select {KEYS}, (l_partkey % 9)::integer as position, radians(l_suppkey % 8 * 45) as a, l_quantity as w, l_quantity / 2 as h from lineitem), e as (select *, (w * abs(cos(a)) + h * abs(sin(a))) / 2 as hw, (w * abs(sin(a)) + h * abs(cos(a))) / 2 as hh from g)
select {KEYS}, round(case position % 3 when 0 then 20 + hw when 2 then 600 - 20 - hw else 300 end, 5) as x, round(case position // 3 when 0 then 800 - 20 - hh when 2 then 20 + hh else 400 end, 5) as y from e""")
def stamp_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    at = workspace.stamp_place(F.lit(600.0), F.lit(800.0), q, q / 2, (F.col("l_partkey") % 9).cast("int"), (F.col("l_suppkey") % 8 * 45).cast("double"), 20.0)
    return read(spark, sf_dir, "lineitem").select(*KEY, at.alias("p")).select(*KEY, F.round("p.x", 5).alias("x"), F.round("p.y", 5).alias("y"))


@query(f"""with i as (select {KEYS}, (l_partkey % 900 + 1)::double as w, (l_suppkey % 70 + 1) * 10.0 as h from lineitem), s as (select *, case when w > h then 842.0 else 595.0 end as pw, case when w > h then 595.0 else 842.0 end as ph from i), f as (select *, least((pw - 72) / w, (ph - 72) / h) as k from s)
select {KEYS}, round(w * 0.75, 5) as bare, round(pw, 5) as width, round((pw - w * k) / 2, 5) as l, round((ph + h * k) / 2, 5) as t from f""")
def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = (F.col("l_partkey") % 900 + 1).cast("double"), ((F.col("l_suppkey") % 70 + 1) * 10).cast("double")
    bare, sheet = workspace.image_page(w, h), workspace.image_page(w, h, 595.0, 842.0, 36.0)
    rows = read(spark, sf_dir, "lineitem").select(*KEY, bare.alias("b"), sheet.alias("s"))
    return rows.select(*KEY, F.round("b.width", 5).alias("bare"), F.round("s.width", 5).alias("width"), F.round("s.l", 5).alias("l"), F.round("s.t", 5).alias("t"))


@query(f"""with b as (select {KEYS}, l_discount as l, l_tax as t, l_discount + l_linenumber / 1000.0 as r, l_tax + 0.5 as b from lineitem)
select {KEYS}, round(greatest(0, l - 0.5 / 600 - greatest(0, 3.0 / 600 - (r - l + 1.0 / 600)) / 2), 6) as l, round(least(1, b + 0.5 / 800 + greatest(0, 3.0 / 800 - (b - t + 1.0 / 800)) / 2), 6) as b from b""")
def padded_areas(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, t = F.col("l_discount"), F.col("l_tax")
    box = F.struct(l.alias("l"), t.alias("t"), (l + F.col("l_linenumber") / 1000.0).alias("r"), (t + 0.5).alias("b"))
    rows = read(spark, sf_dir, "lineitem").select(*KEY, workspace.padded_area(box, 0.5, F.lit(600.0), F.lit(800.0)).alias("a"))
    return rows.select(*KEY, F.round("a.l", 6).alias("l"), F.round("a.b", 6).alias("b"))


@query(f"""with {PARS}, p as (select doc_id, string_agg(text, chr(10) || chr(10) order by par_no) filter (where text <> '') as text, count(*) as n, max(length(text)) as longest, sum(length(text) + 2) as used from pars group by doc_id)
select doc_id, md5(replace(text, 'e', 'E')) as note from p where text is not null and used <= 5000""")
def notes_of_short_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model that stands in, another letter, says of documents that fit in one part."""
    notes = workspace.summary_notes(retrieval.parts(read(spark, sf_dir, "documents")), lambda t: F.replace(t, F.lit("e"), F.lit("E")))
    pars = retrieval.paragraphs(read(spark, sf_dir, "documents")).groupBy("doc_id").agg(F.sum(F.length("text") + 2).alias("used"))
    return notes.join(pars.where("used <= 5000"), "doc_id").select("doc_id", F.md5(F.col("note").cast("binary")).alias("note"))
