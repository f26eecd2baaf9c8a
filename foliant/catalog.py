"""Queries of the document operators over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.functions import text as T
from foliant.operators import compare, forms, graphs, layout, measures, pages, retrieval, search, spatial
from foliant.registry import QUERIES, SQL, Query, query, read
from foliant.sources import html, markdown, pdf

def pars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.paragraphs(read(spark, sf_dir, "documents"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.questions(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


# Parts of SQL that several queries begin with.
STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
WORDS = f"""list_distinct([regexp_replace(w, 's$', '') for w in regexp_extract_all(lower(%s), '[\\p{{L}}\\p{{N}}]{{3,}}') if w not in ({STOP})])"""
PARS = """
lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as par_no from documents),
pars as (select doc_id, par_no::integer as par_no, (par_no // 10 + 1)::integer as page_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) as text from lines)
"""
ASKED = "asked as (select d.doc_id, b.item_id, b.text as question from documents d join benchmark b on b.item_id = d.doc_id % (select max(item_id) + 1 from benchmark))"
BM25 = f"""
with {PARS}, {ASKED},
sized as (select doc_id, par_no, length(text) as size, {WORDS % "text"} as words from pars),
totals as (select doc_id, count(*) as n, avg(size) as average from sized group by doc_id),
held as (select s.doc_id, par_no, size, n, average, unnest(list_intersect(s.words, {WORDS % "question"})) as word from sized s join asked using (doc_id) join totals using (doc_id)),
holding as (select doc_id, word, count(*) as held from held group by all),
scored as (select doc_id, par_no, size, sum(ln(1 + (n - held + 0.5) / (held + 0.5))) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * size / any_value(average))) as score
           from held join holding using (doc_id, word) group by doc_id, par_no, size)
"""


@query(BM25 + "select doc_id, par_no, size, round(score, 6) as score from scored where score > 0")
def bm25_relevant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.bm25(pars(spark, sf_dir), asked(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query(BM25.replace("with", "with recursive", 1) + """, s as (select p.doc_id, p.par_no, length(p.text) as size, round(score, 9) as score from pars p left join (select * from scored where score > 0) using (doc_id, par_no)),
per as (select doc_id, sum(size) as total, max(score) as best from s group by doc_id),
ranked as (select s.*, total, row_number() over (partition by doc_id order by -coalesce(score, 0), par_no) as k from s join per using (doc_id) where total > 10000 and (best is null or score is not null)),
walk as (select doc_id, k, par_no, size::bigint as length, true as keep from ranked where k = 1
  union all select r.doc_id, r.k, r.par_no, case when w.length >= 10000 or w.length + r.size > 10000 then w.length else w.length + r.size end, not (w.length >= 10000 or w.length + r.size > 10000) from walk w join ranked r on r.doc_id = w.doc_id and r.k = w.k + 1)
select doc_id, par_no from s join per using (doc_id) where total <= 10000 union all select doc_id, par_no from walk where keep""")
def bm25_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.excerpts(pars(spark, sf_dir), asked(spark, sf_dir))


@query(f"with {PARS} select word, count(*) as paragraphs from (select unnest({WORDS % 'text'}) as word from pars) group by word")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = pars(spark, sf_dir).select(F.explode(T.word_set(F.col("text"))).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("paragraphs"))


@query(f"with {PARS} select doc_id, par_no, page_no, len({WORDS % 'text'})::integer as words from pars")
def paragraph_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pars(spark, sf_dir).select("doc_id", "par_no", "page_no", F.size(T.word_set(F.col("text"))).alias("words"))


@query(f"""with {PARS}, shaped as (select *, regexp_replace(lower(text), '[0-9]+', '#', 'g') as shape from pars),
often as (select doc_id, shape, count(distinct page_no) as n from shaped group by all)
select doc_id, par_no, page_no, text from shaped join often using (doc_id, shape) where length(text) > 1 and not (length(text) < 120 and n >= 3)""")
def without_running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.without_heads(pars(spark, sf_dir))


POINTS = "points as (select doc_id, par_no as point_no, text from pars where length(text) > 1)"


@query(f"""with {PARS}, {POINTS},
counts as (select doc_id, word, count(*) as n from (select doc_id, unnest({WORDS % "text"}) as word from pars) group by all),
own as (select doc_id, point_no, unnest({WORDS % "text"}) as word from points),
means as (select doc_id, point_no, avg(ln(1 + coalesce(n, 0))) as score from own left join counts using (doc_id, word) group by all),
scored as (select p.*, round(coalesce(score, 0.0), 6) as score, row_number() over (partition by doc_id order by round(coalesce(score, 0.0), 9) desc, point_no) as r from points p left join means using (doc_id, point_no))
select doc_id, point_no, text, score from scored where r <= 5""")
def central_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pars(spark, sf_dir)
    points = p.where(F.length("text") > 1).select("doc_id", F.col("par_no").alias("point_no"), "text")
    return retrieval.central(points, p, 5).withColumn("score", F.round("score", 6))


SHARES = f"""with {PARS}, {ASKED},
said as (select doc_id, {WORDS % "question"} as words from asked),
held as (select doc_id, par_no, page_no, {WORDS % "text"} as own from pars),
shares as materialized (select doc_id, par_no, page_no, len(list_intersect(own, words)) / len(words)::double as share from held join said using (doc_id) where len(words) > 0)
"""


@query(SHARES + """, best as (select doc_id, par_no, page_no, share, row_number() over (partition by doc_id order by share desc, par_no) as r from shares where share > 0)
select a.doc_id, case when share >= 0.3 then par_no end as par_no, case when share >= 0.3 then page_no else first end as page_no
from asked a join (select doc_id, min(page_no) as first from pars group by doc_id) using (doc_id) left join (select * from best where r = 1) using (doc_id)""")
def trace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.traced(asked(spark, sf_dir).select("doc_id", F.col("question").alias("said")), pars(spark, sf_dir))


@query(SHARES + """select doc_id, par_no, share from (select *, row_number() over (partition by doc_id order by share desc, par_no) as r from shares where share >= 0.2) where r <= 3""")
def answer_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.sources(asked(spark, sf_dir).select("doc_id", F.col("question").alias("said")), pars(spark, sf_dir))


CUT = "case when length({0}) <= 5000 then length({0}) when instr(reverse({0}[1:5001]), ' ') in (0, 5001) then 5000 else 5002 - instr(reverse({0}[1:5001]), ' ') end"


@query(f"""with recursive {PARS}, cuts as (select doc_id, par_no, 0 as n, text[1:{CUT.format("text")}] as piece, text[{CUT.format("text")} + 1:] as rest from pars where text <> ''
  union all select doc_id, par_no, n + 1, rest[1:{CUT.format("rest")}], rest[{CUT.format("rest")} + 1:] from cuts where rest <> ''),
pieces as (select doc_id, par_no, trim(piece) as text, row_number() over (partition by doc_id order by par_no, n) as k from cuts),
walk as (select doc_id, k, par_no, text, 0 as part_no, length(text)::bigint + 2 as used from pieces where k = 1
  union all select p.doc_id, p.k, p.par_no, p.text, case when w.used + length(p.text) > 5000 then w.part_no + 1 else w.part_no end, case when w.used + length(p.text) > 5000 then 0 else w.used end + length(p.text) + 2
  from walk w join pieces p on p.doc_id = w.doc_id and p.k = w.k + 1)
select doc_id, part_no::integer as part_no, par_no, text as piece from walk""")
def parts_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.parts(read(spark, sf_dir, "documents"))


@query("select conv_id, turn, role, text, back from (select *, row_number() over (partition by conv_id order by turn desc)::integer as back from conversations) where back <= 3")
def chat_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.last_turns(read(spark, sf_dir, "conversations"))


@query(r"""with lines as (select conv_id, turn, [x for x in list_transform(string_split(text, chr(10)), lambda y: trim(y, chr(32) || chr(9) || chr(13) || chr(11) || chr(12))) if x <> ''] as ls from conversations),
chosen as (select *, [x for x in ls if regexp_matches(x, '^([-*•]|[0-9]+[.)])\s+')] as listed from lines),
points as (select conv_id, turn, case when len(listed) > 0 then listed else [x for x in ls if not ends_with(x, ':')] end as c from chosen),
bare as (select conv_id, turn, [x for x in [trim(replace(regexp_replace(x, '^([-*•]|[0-9]+[.)])\s+', ''), '**', '')) for x in c] if x <> ''] as points from points)
select conv_id, turn, len(points)::integer as points, array_to_string(points, '|') as joined from bare""")
def listed_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = read(spark, sf_dir, "conversations").select("conv_id", "turn", T.listed_points(F.col("text")).alias("p"))
    return found.select("conv_id", "turn", F.size("p").alias("points"), F.array_join("p", "|").alias("joined"))


@query(f"with {PARS} select doc_id, par_no, ((length(lower(text)) - length(replace(lower(text), 'the ', ''))) // 4)::bigint as hits from pars where contains(lower(text), 'the ')")
def find_text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pars(spark, sf_dir).withColumn("text", F.lower("text"))
    return p.where(F.contains("text", F.lit("the "))).select("doc_id", "par_no", F.regexp_count("text", F.lit("the ")).cast("long").alias("hits"))


@query(f"""with {PARS}, p as (select doc_id, par_no, string_split(lower(text), 'of the') as p from pars), u as (select doc_id, par_no, p, unnest(generate_series(1, len(p) - 1)) as i from p where len(p) > 1)
select doc_id, par_no, length(array_to_string(p[1:i], 'of the'))::integer as at from u""")
def find_text_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.found(pars(spark, sf_dir), "of the")


# Pages: each order is a document, its lines in a total order are pages.
PAGES = """pages as (select l_orderkey as source, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate)::integer as page_no,
  (l_suppkey % 4 * 90)::integer as rotate, 612.0::double as width, 792.0::double as height from lineitem)"""


def page_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source"), F.row_number().over(order).alias("page_no"), (F.col("l_suppkey") % 4 * 90).cast("int").alias("rotate"), F.lit(612.0).alias("width"), F.lit(792.0).alias("height")
    )


def every_other(p: DataFrame) -> DataFrame:
    return p.where("page_no % 2 = 0").select("source", "page_no")


@query(f"with {PAGES} select source, page_no, ((page_no - 1) // 2)::integer as part from pages")
def split_every_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_every(page_table(spark, sf_dir), 2).select("source", "page_no", "part")


@query(f"with {PAGES}, r(part, low, high) as (values (0, 3, 4), (1, 1, 3)) select source, part::integer as part, (page_no - low)::integer as pos, page_no from pages join r on page_no between low and high")
def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_ranges(page_table(spark, sf_dir), [(3, 4), (1, 3)])


@query(f"""with {PAGES}, r(part, low, high) as (values (0, 3, 4), (1, 1, 3)), hits as (select source, page_no, min(part * 100 + page_no - low) as first from pages join r on page_no between low and high group by all)
select source, 0 as part, (row_number() over (partition by source order by first) - 1)::integer as pos, page_no from hits""")
def split_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.split_ranges(page_table(spark, sf_dir), [(3, 4), (1, 3)], combine=True)


@query(f"with {PAGES} select row_number() over (order by source, page_no) as out_no, source, page_no from pages")
def merge_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.merge(page_table(spark, sf_dir))


@query(f"with {PAGES}, c as (select source, count(*) as n from pages group by source) select source, n, (coalesce(sum(n) over (order by source rows between unbounded preceding and 1 preceding), 0) + 1)::bigint as opens_at from c")
def merge_bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.offsets(page_table(spark, sf_dir))


@query(f"""with {PAGES} select (100 * source + 10 - page_no)::bigint as pos, source, page_no, ((rotate + 90) % 360)::integer as rotate, width, height from pages
union all select 100 * source, null, null, 0, 200.0, 300.0 from (select distinct source from pages)""")
def organize_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir)
    none = F.lit(None).cast("double")
    own = p.select((100 * F.col("source") + 10 - F.col("page_no")).alias("pos"), F.lit("page").alias("kind"), "source", "page_no", F.lit(90).alias("turn"), none.alias("width"), none.alias("height"))
    blank = p.select("source").distinct().select((100 * F.col("source")).alias("pos"), F.lit("blank").alias("kind"), "source", F.lit(None).cast("int").alias("page_no"), F.lit(0).alias("turn"), F.lit(200.0).alias("width"), F.lit(300.0).alias("height"))
    return pages.organize(p, own.unionByName(blank))


@query(f"with {PAGES} select source, page_no from pages where page_no % 2 = 0")
def extract_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir)
    return pages.extract(p, every_other(p)).select("source", "page_no")


@query(f"with {PAGES} select source, page_no from pages where page_no % 2 <> 0")
def remove_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir)
    return pages.remove(p, every_other(p)).select("source", "page_no")


@query(f"""with {PAGES}, own as (select * from pages where page_no % 2 = 0), s as (select source, min(page_no) as low, max(page_no) as high from own group by source)
select source, page_no, 'Page ' || (5 + page_no - low) || ' of ' || (5 + high - low) as label from own join s using (source)""")
def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = page_table(spark, sf_dir)
    return pages.number(p, every_other(p), 5, "Page {n} of {total}")


RANGES = ("1,3-5", " 2 - 3 ,x, 9-1,3x", "1-2-9,-5", "", "7,7,6-99", "0-2,4", "3-4x, 1 ,")


@query("""with r(spec, wanted) as (values ('1,3-5', [1,3,4,5]), (' 2 - 3 ,x, 9-1,3x', [2,3]), ('1-2-9,-5', [1,2]), ('7,7,6-99', [6,7,8]), ('0-2,4', [4]), ('3-4x, 1 ,', [1,3,4]))
select spec, unnest(wanted)::bigint as page_no from r""")
def page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = spark.createDataFrame([(s,) for s in RANGES], "spec string")
    return specs.select("spec", F.explode(pages.page_range(F.col("spec"), F.lit(8))).alias("page_no"))


# Objects: documents are streams, copies are equal objects.
@query("select d.doc_id as id, k.keeper from documents d join (select text, lang, min(doc_id) as keeper from documents group by all) k on d.text = k.text and d.lang = k.lang")
def share_identical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.keepers(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("kind"), F.col("text").alias("content")))


def object_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders as objects that refer to the order of three times their number and one; not every fifth."""
    ids = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    refs = ids.select(F.col("id").alias("src"), (F.col("id") * 3 + 1).alias("dst")).where("src % 5 <> 0")
    return ids, refs


GRAPH = "ids as (select o_orderkey as id from orders), refs as (select id as src, id * 3 + 1 as dst from ids where id % 5 <> 0)"


@query(f"with recursive {GRAPH}, seen as (select id from ids where id % 97 = 1 union select dst from refs join seen on src = seen.id) select id from ids where id not in (select id from seen)")
def unreachable_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, refs = object_graph(spark, sf_dir)
    return graphs.unreachable(ids, refs, ids.where("id % 97 = 1"))


@query(f"with {GRAPH} select src, dst from refs where dst not in (select id from ids)")
def dangling_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, refs = object_graph(spark, sf_dir)
    return graphs.dangling(ids, refs).select("src", "dst")


TREE = "nodes as (select o_orderkey as id, case when o_orderkey >= 4 then o_orderkey // 4 end as parent, case when o_orderkey % 11 = 0 or o_orderkey < 4 then o_orderkey end as media from orders)"


@query(f"""with recursive {TREE}, up as (select id, id as at, 0 as depth from nodes union all select up.id, n.parent, depth + 1 from up join nodes n on n.id = up.at where n.media is null and n.parent is not null)
select up.id, n.media as value, depth::integer as depth from up left join nodes n on n.id = up.at where n.media is not null or n.parent is null""")
def inherited_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    nodes = read(spark, sf_dir, "orders").select(k.alias("id"), F.when(k >= 4, F.floor(k / 4)).alias("parent"), F.when((k % 11 == 0) | (k < 4), k).alias("media"))
    return graphs.inherited(nodes, "media")


HEADINGS = "headings as (select doc_id, par_no as idx, (length(text) % 4 + 1)::integer as level from pars)"


def heading_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pars(spark, sf_dir).select("doc_id", F.col("par_no").alias("idx"), (F.length("text") % 4 + 1).alias("level"))


@query(f"with {PARS}, {HEADINGS} select h.doc_id, h.idx, h.level, max(p.idx) as parent from headings h left join headings p on p.doc_id = h.doc_id and p.idx < h.idx and p.level < h.level group by all")
def outline_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.heading_parents(heading_table(spark, sf_dir))


@query(f"""with {PARS}, {HEADINGS}, ends as (select h.doc_id, h.idx, min(n.idx) as stop from headings h left join headings n on n.doc_id = h.doc_id and n.idx > h.idx and n.level <= h.level group by all)
select e.doc_id, e.idx, count(o.idx)::integer as below from ends e left join headings o on o.doc_id = e.doc_id and o.idx > e.idx and (e.stop is null or o.idx < e.stop) group by all""")
def outline_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graphs.subtree_counts(heading_table(spark, sf_dir))


# Glyphs: a character grid over two pages for each part, made of its name; the middle of a row has a gap.
GLYPHS = """names as (select p_partkey as source, unnest(generate_series(0, 119)) as i, p_name from part),
glyphs as (select source, (1 + i // 60)::integer as page_no, i::integer as glyph_no, substr(p_name || ' of the ', (i % (length(p_name) + 8) + 1)::bigint, 1) as text, (i % 60 // 20)::integer as row_no,
  (i % 20) * 0.04::double + (i % 20 // 10) * 0.03::double as l, (i % 60 // 20) * 0.25 + 0.1 as t, (i % 20) * 0.04::double + 0.035::double + (i % 20 // 10) * 0.03::double as r, (i % 60 // 20) * 0.25 + 0.15 as b from names),
areas as (select source, page_no, unnest([0.0, 0.5]) as l, unnest([0.09, 0.36]) as t, unnest([0.1 + source % 25 * 0.011, 0.775]) as r, unnest([0.12, 0.41]) as b from (select distinct source, page_no from glyphs)),
met as (select g.source, g.page_no, g.glyph_no, sum(case when least(g.r, a.r) > greatest(g.l, a.l) and least(g.b, a.b) > greatest(g.t, a.t) then (least(g.r, a.r) - greatest(g.l, a.l)) * (least(g.b, a.b) - greatest(g.t, a.t)) else 0 end) as o,
  bool_or(g.l >= a.l and g.r <= a.r and g.t >= a.t and g.b <= a.b) as inside from glyphs g join areas a using (source, page_no) group by all)"""


def glyph_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("i")
    names = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"), F.explode(F.sequence(F.lit(0), F.lit(119))).alias("i"), F.concat("p_name", F.lit(" of the ")).alias("name"))
    row, gap = F.floor(i % 60 / 20), F.floor(i % 20 / 10) * F.lit(0.03)
    d = lambda c: c.cast("double")
    return names.select(
        "source", (1 + F.floor(i / 60)).cast("int").alias("page_no"), i.alias("glyph_no"), F.substring("name", i % F.length("name") + 1, F.lit(1)).alias("text"),
        d(i % 20 * F.lit(0.04) + gap).alias("l"), d(row * F.lit(0.25) + 0.1).alias("t"), d(i % 20 * F.lit(0.04) + 0.035 + gap).alias("r"), d(row * F.lit(0.25) + 0.15).alias("b"),
    )


def area_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = glyph_table(spark, sf_dir).select("source", "page_no").distinct()
    one = lambda *v: F.struct(*[F.lit(x).cast("double").alias(n) if not hasattr(x, "cast") else x.cast("double").alias(n) for n, x in zip("ltrb", v, strict=True)])
    return base.select("source", "page_no", F.inline(F.array(one(0.0, 0.09, F.lit(0.1) + F.col("source") % 25 * 0.011, 0.12), one(0.5, 0.36, 0.775, 0.41))))


@query(f"with {GLYPHS} select g.source, g.page_no, g.glyph_no, g.text from glyphs g left join met using (source, page_no, glyph_no) where coalesce(o, 0) < 0.25 * ((g.r - g.l) * (g.b - g.t))")
def redact_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.kept(glyph_table(spark, sf_dir), area_table(spark, sf_dir)).select("source", "page_no", "glyph_no", "text")


@query(f"with {GLYPHS} select g.source, g.page_no, g.glyph_no from glyphs g join met using (source, page_no, glyph_no) where o >= 0.25 * ((g.r - g.l) * (g.b - g.t)) and not inside")
def spilled_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spatial.spilled(glyph_table(spark, sf_dir), area_table(spark, sf_dir)).select("source", "page_no", "glyph_no")


@query(f"""with {GLYPHS}, m as (select *, coalesce(abs((t + b) / 2 - (lag(t) over w + lag(b) over w) / 2) >= 0.05 / 2, true) as new_line, trim(text) = '' as blank, coalesce(trim(lag(text) over w) = '' or l - lag(r) over w > greatest(lag(r) over w - lag(l) over w, r - l) / 3, true) as was_blank from glyphs window w as (partition by source, page_no order by glyph_no)),
s as (select *, sum(new_line::integer) over w - 1 as line_no, sum((not blank and (new_line or was_blank))::integer) over w - 1 as word_no from m window w as (partition by source, page_no order by glyph_no rows between unbounded preceding and current row))
select source, page_no, line_no::bigint as line_no, word_no::bigint as word_no, string_agg(text, '' order by glyph_no) as text, round(min(l)::double, 6) as l, round(max(r)::double, 6) as r from s where not blank group by source, page_no, line_no, word_no""")
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = spatial.words(glyph_table(spark, sf_dir))
    return w.select("source", "page_no", "line_no", "word_no", "text", F.round("l", 6).alias("l"), F.round("r", 6).alias("r"))


# Measures.
@query("with s as (select source, n_chars, row_number() over (partition by source order by n_chars) - 1 as i, count(*) over (partition by source) as n from documents) select source, n_chars as median from s where i = n // 2")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.upper_median(read(spark, sf_dir, "documents"), ["source"], "n_chars")


@query("with s as (select lang, n_chars, row_number() over (partition by lang order by n_chars) - 1 as i, count(*) over (partition by lang) as n from documents) select lang, n_chars as percentile from s where i = n // 100")
def black_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.percentile(read(spark, sf_dir, "documents"), ["lang"], "n_chars", 100, 1)


@query("with c as (select source, lang, sum(n_chars)::bigint as amount, max(doc_id) as last from documents group by all) select source, arg_max(lang, amount::hugeint * 1000000000 - last) as mode, max(amount) as amount from c group by source")
def weighted_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.mode(read(spark, sf_dir, "documents"), ["source"], "lang", "doc_id", "n_chars")


@query("with c as (select source, lang, count(*) as votes, min(doc_id) as first from documents group by all) select source, arg_max(lang, votes::hugeint * 1000000000 - first) as winner, max(votes) as votes from c group by source")
def page_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.vote(read(spark, sf_dir, "documents"), ["source"], "lang", "doc_id")


@query("select l_returnflag, max(l_quantity) - min(l_quantity) as spread from lineitem group by l_returnflag")
def value_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.spread(read(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")


@query("""with v as (select l_returnflag, least(floor(l_extendedprice / 200000.0 * 128), 127)::integer as bin, count(*) as n from lineitem group by all),
s as (select *, sum(n) over w as n_low, sum(n * bin) over w as s_low, sum(n) over (partition by l_returnflag) as n_all, sum(n * bin) over (partition by l_returnflag) as s_all from v window w as (partition by l_returnflag order by bin)),
b as (select l_returnflag, bin, coalesce(n_low * (n_all - n_low) * (s_low / n_low - (s_all - s_low) / nullif(n_all - n_low, 0)) ** 2, 0) as between_ from s)
select l_returnflag, bin from (select *, row_number() over (partition by l_returnflag order by round(between_, 6) desc, bin) as r from b) where r = 1""")
def otsu_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_extendedprice") / 200000.0).alias("v"))
    return measures.otsu(items, ["l_returnflag"], "v")


@query("""with p as (select l_returnflag as page, (l_partkey % 256)::integer as r, (l_suppkey % 64)::integer as g, l_linenumber::integer as b from lineitem),
c as (select page, (r >> 3) * 1024 + (g >> 3) * 32 + (b >> 3) as bucket, count(*) as n, avg(r) as r, avg(g) as g, avg(b) as b from p group by all)
select page, round(r, 4) as red, round(g, 4) as green, round(b, 4) as blue, n from (select *, row_number() over (partition by page order by n desc, bucket) as k from c) where k = 1""")
def common_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem")
    pixels = items.select(F.col("l_returnflag").alias("page"), (F.col("l_partkey") % 256).cast("int").alias("r"), (F.col("l_suppkey") % 64).cast("int").alias("g"), F.col("l_linenumber").cast("int").alias("b"))
    return measures.common_color(pixels, ["page"])


@query("select user_id, count(*) as tokens, round((count(*) - 1) * 1e6 / nullif(epoch_us(max(ts)) - epoch_us(min(ts)), 0), 9) as per_second from events group by user_id")
def generation_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.generation_rate(read(spark, sf_dir, "events"), ["user_id"])


@query("select doc_id, lang, source from (select *, row_number() over (partition by text, source order by doc_id) as n from documents) where n = 1")
def duplicate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.keep_first(read(spark, sf_dir, "documents"), ["text", "source"], ["doc_id"]).select("doc_id", "lang", "source")


@query("select sum(length(text))::bigint as chars, sum(length(regexp_replace(text, '\\s+', ' ', 'g')))::bigint as squeezed, round(sum(length(regexp_replace(text, '\\s+', ' ', 'g'))) / sum(length(text)), 9) as ratio from documents")
def size_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    squeezed = F.sum(F.length(F.regexp_replace("text", r"\s+", " ")))
    return read(spark, sf_dir, "documents").agg(F.sum(F.length("text")).alias("chars"), squeezed.alias("squeezed"), F.round(squeezed / F.sum(F.length("text")), 9).alias("ratio"))


# HTML pages.
@query(r"select page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) as title from pages")
def html_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", html.title(F.col("html")).alias("title"))


@query(r"""with h as (select page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') as hs from pages), u as (select page_id, unnest(hs) as h, generate_subscripts(hs, 1) as n from h)
select page_id, n::integer as n, regexp_extract(h, '(?i)^<h([1-6])', 1)::integer as level, trim(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) as title from u where trim(regexp_replace(regexp_replace(h, '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) <> ''""")
def html_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.headings(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


@query(r"""with h as (select page_id, regexp_extract_all(html, '(?is)<a\s[^>]*?href="([^"]*)"', 1) as hs from pages), u as (select page_id, unnest(hs) as target, generate_subscripts(hs, 1) as n from h)
select page_id, n::integer as n, target, case when starts_with(target, '#') then 'place' when regexp_matches(target, '(?i)^(https?:|mailto:|tel:|ftp:)') then 'address' else 'dropped' end as kind from u""")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.anchors(read(spark, sf_dir, "pages").select("page_id", "html"), "page_id")


@query(r"""select page_id, len(regexp_extract_all(html, '(?i)<script\b'))::bigint as scripts, len(regexp_extract_all(html, '(?i)<iframe\b'))::bigint as iframes, len(regexp_extract_all(html, '(?i)<meta\b[^>]*http-equiv'))::bigint as metas,
length(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<(iframe|object|embed|base|link|meta\b[^>]*http-equiv)\b[^>]*>', '', 'g'))::bigint as kept from pages""")
def html_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    h = F.col("html")
    count = lambda pattern: F.regexp_count(h, F.lit(pattern)).cast("long")
    return p.select("page_id", count(r"(?i)<script\b").alias("scripts"), count(r"(?i)<iframe\b").alias("iframes"), count(r"(?i)<meta\b[^>]*http-equiv").alias("metas"), F.length(html.sanitized(h)).cast("long").alias("kept"))


@query("select doc_id, len(list_distinct(string_split(text, '')))::integer as characters from documents")
def unique_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.size(F.array_distinct(F.split("text", ""))).alias("characters"))


@query(r"select page_id, replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as url from pages".replace('\\"', '"'))
def escaped_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").select("page_id", T.html_escape(F.col("url")).alias("url"))


@query()
def compared_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself without some of its words."""
    docs = read(spark, sf_dir, "documents")
    pairs = docs.select("doc_id", F.col("text").alias("original"), F.regexp_replace("text", r"\b(the|de|der) ", "").alias("changed"))
    return compare.marked(compare.compare(pairs, "doc_id")).select("doc_id", "change_no", "removed", "added", "kind", "comment")


def sized_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glyph_table(spark, sf_dir).withColumns({"size": F.lit(24.0), "width": F.lit(600.0), "height": F.lit(800.0)})


RUNS = f"""{GLYPHS}, shown as (select *, min(case when trim(text) <> '' then glyph_no end) over w as low, max(case when trim(text) <> '' then glyph_no end) over w as high from glyphs window w as (partition by source, page_no, row_no)),
rows as (select source, page_no, row_no, min(l) * 600 as x0, max(r) * 600 as x1, max(b) * 800 as y, trim(regexp_replace(string_agg(case when glyph_no % 20 = 10 and glyph_no > low then ' ' else '' end || text, '' order by glyph_no), '\\s+', ' ', 'g')) as text
  from shown where glyph_no between low and high group by all)"""


@query(f"with {RUNS} select source, page_no, (row_number() over (partition by source, page_no order by row_no) - 1)::integer as run_no, round(x0, 6) as x0, round(x1, 6) as x1, round(y, 6) as y, 24.0::double as size, text, false as bold from rows")
def text_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.runs(sized_glyphs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("x0", "x1", "y")})


@query(f"""with {RUNS}, worth as (select * from rows where length(regexp_replace(text, '[^a-zA-Z]', '', 'g')) > 1)
select source, page_no, (row_number() over (partition by source, page_no order by row_no) - 1)::integer as block_no, round(x0, 6) as x0, round(x1, 6) as x1, round(y, 6) as y, 24.0::double as size, 1 as lines,
  case when abs((x0 + x1) / 2 - 300) <= 12 and x0 > 90 then 'center' when x0 > 300 and x1 > 510 then 'right' else 'left' end as align, false as bold, text from worth""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.blocks(sized_glyphs(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("x0", "x1", "y")})


@query("""with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity as a, l_discount as b, l_tax as c, l_quantity + 1 as d, l_partkey % 7 as e, l_suppkey % 5 as f from lineitem),
i as (select *, a * d - b * c as det from p)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(d / det, 6) as a, round((c * f - d * e) / det, 6) as e, round(a * 2 + c * 3 + e, 6) as x, round(b * 2 + d * 3 + f, 6) as y from i""")
def affine_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity")
    m = F.array(q, F.col("l_discount"), F.col("l_tax"), q + 1, (F.col("l_partkey") % 7).cast("double"), (F.col("l_suppkey") % 5).cast("double"))
    framed = read(spark, sf_dir, "lineitem").withColumn("m", m)
    inverse, at = geometry.inverted(F.col("m")), geometry.transformed(F.col("m"), F.lit(2.0), F.lit(3.0))
    return framed.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(inverse[0], 6).alias("a"), F.round(inverse[4], 6).alias("e"), F.round(at["x"], 6).alias("x"), F.round(at["y"], 6).alias("y"))


@query("select l_orderkey, l_linenumber, l_partkey, l_suppkey, ((l_partkey % 256 * 77 + l_suppkey % 256 * 150 + l_linenumber % 256 * 29) >> 8)::bigint as gray, round((0.299 * (l_partkey % 256) + 0.587 * (l_suppkey % 256) + 0.114 * l_linenumber)::double, 6) as luminance from lineitem")
def gray_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, g, b = F.col("l_partkey") % 256, F.col("l_suppkey") % 256, F.col("l_linenumber").cast("long") % 256
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", geometry.gray_of(r, g, b).alias("gray"), F.round(geometry.luminance(r, g, b), 6).alias("luminance"))


@query("""with b as (select l_orderkey, l_partkey, (l_linenumber * 10)::integer as a, (l_linenumber * 10 + l_quantity)::integer as b from lineitem),
m as (select *, max(b) over (partition by l_orderkey order by a, b rows between unbounded preceding and 1 preceding) as reach from b),
i as (select *, sum(case when reach is null or a > reach then 1 else 0 end) over (partition by l_orderkey order by a, b rows between unbounded preceding and current row) as island from m)
select l_orderkey, min(a) as a, max(b) as b from i group by l_orderkey, island""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("l_linenumber") * 10
    spans = read(spark, sf_dir, "lineitem").select("l_orderkey", a.cast("int").alias("a"), F.rint(a + F.col("l_quantity")).cast("int").alias("b"))
    return spatial.merged_intervals(spans, ["l_orderkey"])


@query("select o_orderkey as source, o_orderpriority as name, o_orderstatus as kind, reverse(o_orderpriority) as value from orders where o_orderstatus <> 'F'")
def changed_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as forms: open ones got a new value, the others kept theirs."""
    p = F.col("o_orderpriority")
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source"), p.alias("name"), F.col("o_orderstatus").alias("kind"), p.alias("value"))
    values = orders.select("source", "name", F.when(F.col("kind") != "F", F.reverse("value")).otherwise(F.col("value")).alias("value"))
    return forms.changed_fields(orders, values)


WARNINGS = (("returned", "^R"), ("open", "O$"), ("finished", "."))


@query("""with w as (select l_suppkey as source, case when starts_with(l_returnflag || l_linestatus, 'R') then 0 when ends_with(l_returnflag || l_linestatus, 'O') then 1 else 2 end as place from lineitem)
select source, ['returned', 'open', 'finished'][place + 1] as kind, count(*) as n, place::integer as place from w group by source, place""")
def repair_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source"), F.concat("l_returnflag", "l_linestatus").alias("warning"))
    return forms.repair_report(items, list(WARNINGS))


@query("""with s as (select l_orderkey as list_id, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, case when l_quantity > 45 then l_linenumber end as value from lineitem),
p as (select *, row_number() over (partition by list_id order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::integer as pos from s),
g as (select *, count(value) over (partition by list_id order by pos) as stretch from p)
select list_id, pos, (coalesce(first_value(value) over w, 3) + row_number() over w - 1)::integer as ordinal from g window w as (partition by list_id, stretch order by pos)""")
def list_ordinals(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    items = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("list_id"), F.row_number().over(order).alias("pos"), F.when(F.col("l_quantity") > 45, F.col("l_linenumber")).alias("value"), F.lit(3).alias("start"), F.lit(1).alias("step")
    )
    return measures.list_ordinals(items)


@query("select doc_id, greatest(1, ((len(string_split(text, chr(10))) + 49) // 50))::integer as condition from documents")
def pdf_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as PDF files of fifty lines to a page, and the number of pages that reading them finds."""
    lines = F.split("text", "\n")
    n = F.ceil(F.size(lines) / 50).cast("int")
    split = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array_join(F.slice(lines, i * 50 + 1, F.lit(50)), "\n"))).alias("pos", "part"))
    pages_ = split.select(F.col("doc_id").alias("out"), "pos", F.lit(612.0).alias("width"), F.lit(792.0).alias("height"), F.lit(0).alias("rotate"), pdf.drawn("part").alias("content"))
    files = pdf.write_files(pages_).select(F.col("out").cast("string").alias("path"), F.col("file").alias("content"))
    return pdf.conditions(pdf.read_pages(files)).select(F.col("path").cast("long").alias("doc_id"), "condition")


@query("select conv_id, string_agg(case when role = 'user' then '## ' || text else text end, chr(10) || chr(10) order by turn) as markdown from conversations group by conv_id")
def chat_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.conversation(read(spark, sf_dir, "conversations"))


@query(f"""with {PARS}, p as (select doc_id, page_no, trim(string_agg(text, chr(10) order by par_no), ' ') as text from pars group by all)
select doc_id, coalesce(regexp_replace(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by page_no) filter (where text <> ''), '\\*\\*(\\s*)\\*\\*', '\\1', 'g'), '') as markdown from p group by doc_id""")
def document_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = pars(spark, sf_dir).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("par_no", "text"))).alias("ls"))
    return markdown.document(lines.select("doc_id", "page_no", F.array_join(F.transform("ls", lambda x: x["text"]), "\n").alias("text")))


@query(f"with {PAGES}, c as (select source as job, page_no - 1 as part, count(*) over (partition by source) as n from pages) select job, part::integer as part, case when n = 1 then 'page.pdf' else 'page-' || lpad((part + 1)::varchar, length(n::varchar)::integer, '0') || '.pdf' end as name from c")
def output_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = page_table(spark, sf_dir).select(F.col("source").alias("job"), (F.col("page_no") - 1).alias("part"))
    return markdown.part_names(parts, "page", "pdf")


@query("""with asked(a, most) as (values ('smal', 1), ('rign', 1)),
words as (select p_partkey as pos, unnest(string_split(lower(p_name), ' ')) as w, 0.0 as weight from part union all select p_partkey, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')), 0.3 from part
  union all select p_partkey, unnest(regexp_extract_all(lower(p_brand) || ' pdf', '[a-z0-9]+')), 0.5 from part),
costs as (select pos, a, min(weight + case when w = a then 0 when starts_with(w, a) then 0.12 when contains(w, a) then 0.25 when damerau_levenshtein(a, w) <= most then 0.6 + 0.15 * damerau_levenshtein(a, w) end) as cost from words, asked group by pos, a)
select pos, round(sum(cost)::double, 6) as score from costs group by pos having count(cost) = 2""")
def tool_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue, asked for with two typing errors."""
    tools = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.col("p_name").alias("label"), F.col("p_type").alias("keywords"), F.col("p_brand").alias("category"))
    return search.search(tools, "smal rign").select("pos", F.round("score", 6).alias("score"))


def queries() -> dict[str, Query]:
    from foliant import catalog_files, catalog_marks, catalog_pixels, catalog_reading, catalog_rules, catalog_text, catalog_workspace  # noqa: F401  (they register their queries)

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(SQL)
