"""Queries of files: streams, fonts, HTML, Markdown and PDF, by exact round trips, and of object graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import codecs, fonts
from foliant.operators import graphs
from foliant.registry import query, read
from foliant.sources import html, markdown, pdf


def digest(data: Column) -> Column:
    return F.md5(data.cast("binary"))


@query("select doc_id, md5(text) as inflated, md5(text) as hexed, md5(text) as runs, md5(text) as rows, true as fits from documents")
def stream_round_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as streams, through each filter and back."""
    raw, size = F.col("raw"), F.length("raw")
    docs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("raw"))
    piece = lambda i: F.substring(raw, i * 128 + 1, F.lit(128))
    length = lambda p: F.unhex(F.lpad(F.hex(F.length(p) - 1), 2, "0"))
    runs = F.aggregate(F.sequence(F.lit(0), F.floor((size - 1) / 128).cast("int")), F.lit(b""), lambda a, i: F.concat(a, length(piece(i)), piece(i)))
    return docs.select(
        "doc_id", digest(codecs.inflated(codecs.deflated(raw))).alias("inflated"), digest(codecs.hex_read(F.concat(F.hex(raw), F.lit(" >")).cast("binary"))).alias("hexed"),
        digest(codecs.run_length_read(F.concat(runs, F.lit(b"\x80")))).alias("runs"), digest(codecs.rows_unfiltered(F.concat(F.lit(b"\x02"), raw), size)).alias("rows"),
        (F.length(codecs.packed(raw)) <= size).alias("fits"),
    )


@query("select conv_id, turn, md5(text) as again from conversations")
def ciphered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns ciphered and deciphered with a key of their conversation."""
    key = F.concat(F.lit("key"), F.col("conv_id").cast("string")).cast("binary")
    turns = read(spark, sf_dir, "conversations")
    return turns.select("conv_id", "turn", digest(codecs.rc4_applied(key, codecs.rc4_applied(key, F.col("text").cast("binary")))).alias("again"))


@query("""with c as (select doc_id, text, list_sort(list_distinct(string_split(text, ''))) as cs from documents)
select doc_id, md5(array_to_string(cs, '')) as mapped, len([x for x in cs if unicode(x) < 256 and unicode(x) >= 32 and (unicode(x) < 127 or unicode(x) >= 160)])::integer as latin,
regexp_matches(text, '[^\\x20-\\x7e\\x{a0}-\\x{ff}\\n\\r\\t€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]') as embeds, array_to_string([x for x in list_distinct(string_split(text, '')) if x not in ('a', 'e', 'n', ' ', chr(10)) and unicode(x) > 127 and trim(x) <> ''], '') <> '' as lacks from c""")
def character_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The characters of each document: through a map to Unicode and back, in the standard encoding, and beyond ASCII."""
    text = F.col("text")
    docs = read(spark, sf_dir, "documents").withColumn("cs", F.array_join(F.array_sort(F.array_distinct(F.filter(F.split("text", ""), lambda c: c != ""))), ""))
    ascii_ = F.array(*[F.lit(chr(i)) for i in range(128)])
    codes = fonts.win_ansi_codes(F.col("cs"))
    return docs.select(
        "doc_id", digest(fonts.mapped_text(fonts.unicode_map(F.col("cs")))).alias("mapped"), F.size(F.filter(codes, lambda c: (c >= 32) & ((c < 127) | (c >= 160)))).alias("latin"),
        fonts.needs_embedding(text).alias("embeds"), (fonts.missing(text, ascii_) != "").alias("lacks"),
    )


NAMES = ("uni00410042", "u1F600", "A", "zero.alt", "f_i", "odd", "hyphen")


@query("select p_partkey, ['AB', '😀', 'A', '0', 'fi', null, '-'][(p_partkey % 7 + 1)::integer] as text from part")
def glyph_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, NAMES)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", fonts.glyph_texts(name).alias("text"))


@query("select page_id, md5(html) as digest, len(regexp_extract_all(html, '(?i)<img\\b[^>]*\\bsrc(set)?=[\"'']([^d\"'']|d[^a\"'']|da[^t]|dat[^a]|data[^:])'))::bigint as skipped from pages")
def decoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in three encodings, told by their mark or by default."""
    text = F.col("html")
    raw = F.when(F.col("page_id") % 3 == 0, F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))).when(F.col("page_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-8"))
    return read(spark, sf_dir, "pages").select("page_id", digest(html.decoded(raw)).alias("digest"), html.skipped_images(text).cast("long").alias("skipped"))


@query("select p_partkey, case when p_partkey % 3 = 0 then '' else trim(replace(p_name, '_', '')) || ' ' || p_brand end as title from part")
def markdown_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat(F.lit("before\n## **"), F.col("p_name"), F.lit("** `"), F.col("p_brand"), F.lit("` ##\nafter # no"))
    return read(spark, sf_dir, "part").select("p_partkey", markdown.title(F.when(F.col("p_partkey") % 3 == 0, F.lit("#no title\ntext")).otherwise(body)).alias("title"))


@query("""select conv_id as doc_id, '# Summary of talk ' || conv_id || case when conv_id % 2 = 0 then chr(10) || chr(10) || 'in short' else '' end || chr(10) || chr(10) || string_agg('- ' || text || ' (page ' || (turn + 1) || ')', chr(10) order by turn) as markdown
from conversations group by conv_id""")
def markdown_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("conv_id")
    points = read(spark, sf_dir, "conversations").select(c.alias("doc_id"), F.concat(F.lit("talk "), c.cast("string")).alias("title"), F.when(c % 2 == 0, "in short").otherwise("").alias("overview"), F.col("turn").alias("point_no"), "text", (F.col("turn") + 1).alias("page_no"))
    return markdown.summary(points)


@query("select doc_id, length(replace(text, chr(10), ''))::bigint as glyphs, md5(replace(text, chr(10), '')) as digest from documents")
def pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as PDF files of fifty lines to a page, and the text that reading their glyphs finds."""
    lines = F.split("text", "\n")
    n = F.ceil(F.size(lines) / 50).cast("int")
    parts = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(lines, i * 50 + 1, F.lit(50)), "\n"))).alias("pos", "part"))
    pages = parts.select(F.col("doc_id").alias("out"), "pos", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotate"), pdf.drawn("part").alias("content"))
    files = pdf.write_files(pages).select(F.col("out").cast("string").alias("path"), F.col("file").alias("content"))
    held = pdf.page_texts(pdf.read_pages(files))
    whole = held.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"]), "").alias("text"))
    return whole.select(F.col("path").cast("long").alias("doc_id"), F.length("text").cast("long").alias("glyphs"), digest(F.col("text")).alias("digest"))


GRAPH = "ids as (select o_orderkey * 7 + 3 as id from orders), refs as (select id as src, id + 14 as dst from ids where id % 3 <> 0), n as (select id, row_number() over (order by id) + 9 as new from ids)"


@query(f"with {GRAPH} select s.new as src, coalesce(d.new, (select max(new) + 1 from n)) as dst from refs join n s on s.id = src left join n d on d.id = dst")
def renumbered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "orders").select((F.col("o_orderkey") * 7 + 3).alias("id"))
    refs = ids.select(F.col("id").alias("src"), (F.col("id") + 14).alias("dst")).where("src % 3 <> 0")
    return graphs.renumber(ids, refs, 10)[1]


@query("""with o as (select o_orderkey as id, o_orderstatus as kind, o_custkey as content from orders), first as (select kind, content, min(id) as keeper from o group by all),
m as (select id, kind, keeper from o join first using (kind, content)), e as (select keeper, min(id) as n from m group by keeper)
select count(*)::bigint as objects, sum(keeper)::bigint as checksum from e""")
def shared_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as objects without references: equal ones become one."""
    objects = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"), F.col("o_custkey").cast("string").alias("content"))
    refs = objects.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("p").alias("path")).where("src < 0")
    kept, _ = graphs.share_identical(objects, refs)
    return kept.agg(F.count("*").alias("objects"), F.sum("id").alias("checksum"))
