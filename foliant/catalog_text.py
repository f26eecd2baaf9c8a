"""Queries of text functions: names, markers, escapes, dates, distances, comparison and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.operators import compare, retrieval
from foliant.registry import query, read

PARS = """lines as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as par_no from documents),
pars as (select doc_id, par_no::integer as par_no, trim(regexp_replace(line, '\\s+', ' ', 'g')) as text from lines)"""


@query("""with p as (select l_orderkey, list(l_linenumber::varchar order by l_linenumber, l_partkey) filter (where l_quantity > 20) as pages from lineitem group by l_orderkey)
select l_orderkey, case when pages is null or len(pages) = 0 then '' when len(pages) = 1 then 'page ' || pages[1] else 'pages ' || array_to_string(pages[1:len(pages) - 1], ', ') || ' and ' || pages[len(pages)] end as phrase from p""")
def page_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = F.when(F.col("l_quantity") > 20, F.struct("l_linenumber", "l_partkey"))
    per = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(chosen)).alias("ps"))
    return per.select("l_orderkey", T.page_list(F.transform("ps", lambda p: p["l_linenumber"])).alias("phrase"))


DATES = ("D:{y}{m}{d}093015+02'30'", "D:{y}{m}{d}0930Z", "{y}{m}", "D:{y}{m}{d}11", "D:{y}9901", "D:{y}", "odd {y}")


@query("""with o as (select o_orderkey, strftime(o_orderdate, '%Y') as y, strftime(o_orderdate, '%m') as m, strftime(o_orderdate, '%d') as d from orders)
select o_orderkey, case o_orderkey % 7 when 0 then y || '-' || m || '-' || d || 'T09:30:15+02:30' when 1 then y || '-' || m || '-' || d || 'T09:30Z' when 2 then y || '-' || m when 3 then y || '-' || m || '-' || d || 'T11:00Z' when 5 then y end as date from o""")
def archive_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    when = F.col("o_orderdate")
    forms = []
    for form in DATES:
        text = F.lit(form)
        for sign, pattern in (("{y}", "yyyy"), ("{m}", "MM"), ("{d}", "dd")):
            text = F.replace(text, F.lit(sign), F.date_format(when, pattern))
        forms.append(text)
    chosen = F.element_at(F.array(*forms), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", T.xmp_date(chosen).alias("date"))


@query("""select doc_id, md5(case when regexp_matches(text, '^[\\x00-\\x7f]*$') then text else '<FEFF' || array_to_string([printf('%04X', unicode(c)) for c in string_split(text, '')], '') || '>' end) as digest from documents""")
def text_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.utf16_hex(F.col("text")).cast("binary")).alias("digest"))


@query(r"""select doc_id, md5(replace(replace(replace(replace(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as escaped,
length(case when length(text) > 2000 then text[:2000] || '…' else text end)::bigint as clipped from documents""")
def escaped_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(T.xml_escape(text).cast("binary")).alias("escaped"), F.length(T.clip(text)).cast("long").alias("clipped"))


FONTS = ("ABCDEF+CourierNew-Bold", "TimesNewRomanPS", "LiberationSans-Serif", "Georgia-Black", "Arial", "DejaVuSansMono", "AB+Minion-Semibold")


@query("""select p_partkey, ['courier', 'times', 'helvetica', 'times', 'helvetica', 'courier', 'times'][(p_partkey % 7 + 1)::integer] as family, [true, false, false, true, false, false, true][(p_partkey % 7 + 1)::integer] as bold,
(p_size // 10)::integer as major, case when p_partkey % 3 = 0 then 0 else p_size % 10 end::integer as minor from part""")
def names_of_fonts_and_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    family, bold = T.standard_family(F.element_at(F.array(*map(F.lit, FONTS)), (F.col("p_partkey") % 7 + 1).cast("int")))
    minor = F.when(F.col("p_partkey") % 3 == 0, "x").otherwise((F.col("p_size") % 10).cast("string"))
    version = T.version_key(F.concat(F.floor(F.col("p_size") / 10).cast("string"), F.lit("."), minor))
    return read(spark, sf_dir, "part").select("p_partkey", family.alias("family"), bold.alias("bold"), version["major"].alias("major"), version["minor"].alias("minor"))


KINDS = ("decimal", "lower-roman", "upper-alpha", "decimal-leading-zero", "disc", "none", "lower-greek")


@query("""with m as (select p_partkey, (p_partkey % 7)::integer as k, (p_partkey % 2000 + 1)::integer as n from part),
r as (select *, ['', 'm'][(n // 1000 + 1)::integer] || case when n // 1000 = 2 then 'mm' else '' end || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][n // 100 % 10 + 1]
  || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][n // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][n % 10 + 1] as roman,
  case when n > 702 then chr((64 + (n - 703) // 676 + 1)::integer) else '' end || case when n > 26 then chr((65 + (n - 27) // 26 % 26)::integer) else '' end || chr((65 + (n - 1) % 26)::integer) as alpha,
  case when n > 24 + 576 then string_split('αβγδεζηθικλμνξοπρστυφχψω', '')[(n - 601) // 576 + 1] else '' end || case when n > 24 then string_split('αβγδεζηθικλμνξοπρστυφχψω', '')[(n - 25) // 24 % 24 + 1] else '' end
  || string_split('αβγδεζηθικλμνξοπρστυφχψω', '')[(n - 1) % 24 + 1] as greek from m)
select p_partkey, case k when 0 then n || '.' when 1 then roman || '.' when 2 then alpha || '.' when 3 then lpad(n::varchar, greatest(2, length(n::varchar))::integer, '0') || '.' when 4 then '•' when 6 then greek || '.' end as marker from r""")
def list_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("p_partkey") % 7 + 1).cast("int"))
    return read(spark, sf_dir, "part").select("p_partkey", T.marker_text(kind, (F.col("p_partkey") % 2000 + 1).cast("int")).alias("marker"))


@query("""with w as (select p_partkey, p_name as a, substr(p_name, 2, 1) || substr(p_name, 1, 1) || substr(p_name, 3, 2) || 'x' || substr(p_name, 5) as b from part)
select p_partkey, damerau_levenshtein(a, b)::integer as edits from w""")
def edit_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.col("p_name")
    b = F.concat(F.substring(a, 2, 1), F.substring(a, 1, 1), F.substring(a, 3, 2), F.lit("x"), F.substring(a, 5, 1000))
    return read(spark, sf_dir, "part").select("p_partkey", T.osa_distance(a, b).alias("edits"))


@query(f"""with {PARS}, w as (select doc_id, par_no, unnest(string_split(text, ' ')) as word, generate_subscripts(string_split(text, ' '), 1) as k from pars where text <> ''),
p as (select doc_id as key, (par_no * 100000 + k)::bigint as pos, word from w), f as (select key, word, min(pos) as first from p group by all), i as (select key, word, row_number() over (partition by key order by first) - 1 as id from f)
select key, max(id)::integer as last_id, sum(id * (pos % 7))::bigint as checksum from p join i using (key, word) group by key""")
def interned_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    pars = retrieval.paragraphs(read(spark, sf_dir, "documents"))
    words = pars.where("text <> ''").select("doc_id", "par_no", F.posexplode(F.split("text", " ")).alias("k", "word"))
    rows = words.select(F.col("doc_id").alias("key"), F.lit(0).alias("side"), (F.col("par_no") * F.lit(100000).cast("long") + F.col("k") + 1).alias("pos"), "word")
    return compare.interned(rows).groupBy("key").agg(F.max("id").alias("last_id"), F.sum(F.col("id") * (F.col("pos") % 7)).alias("checksum"))


CHANGED = "w as (select l_orderkey as key, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::integer as k, 1 + l_linenumber // 4 as page_no, l_linenumber // 2 as line_no, l_discount as l, l_quantity as r, l_partkey from lineitem), c as (select * from w where l_partkey % 4 <> 0)"


@query(f"""with {CHANGED}, m as (select *, case when lag(k) over o = k - 1 and lag(page_no) over o = page_no and lag(line_no) over o = line_no then 0 else 1 end as new from c window o as (partition by key order by k)),
i as (select *, sum(new) over (partition by key order by k rows between unbounded preceding and current row) - 1 as place_no from m)
select key, place_no::integer as place_no, any_value(page_no)::integer as page_no, any_value(line_no)::integer as line_no, min(l) as l, max(r) as r from i group by key, place_no""")
def change_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    order, n = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"), F.col("l_linenumber")
    words = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.row_number().over(order).alias("pos"), (1 + F.floor(n / 4)).cast("int").alias("page_no"), F.floor(n / 2).cast("int").alias("line_no"),
        F.col("l_discount").alias("l"), F.lit(0.0).alias("t"), F.col("l_quantity").alias("r"), F.lit(1.0).alias("b"), "l_partkey",
    ).where("l_partkey % 4 <> 0")
    return compare.change_places(words).select("key", F.col("place_no").cast("int").alias("place_no"), "page_no", "line_no", "l", "r")


@query(f"with {PARS} select doc_id, sum(case when text = '' then 0 else len(string_split(text, ' ')) end)::bigint as words from pars group by doc_id")
def compared_with_itself(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document against itself: all of its words are equal, none of them changed."""
    pairs = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("original"), F.col("text").alias("changed"))
    return compare.compare(pairs, "doc_id").select("doc_id", F.col("equal").cast("long").alias("words"))
