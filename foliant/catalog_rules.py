"""Queries of forms, annotations, fonts and archival rules: orders and their lines stand for files and what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.operators import archive, forms
from foliant.registry import query, read


def pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))


def listed(values: tuple) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


FIELD_KINDS = ("text", "check", "radio", "combo", "list")
FIELDS = f"""fields as (select o_orderkey as source, 'f' || (o_custkey % 3) as name, {listed(FIELD_KINDS)}[(o_orderkey % 5 + 1)::integer] as kind,
  case when o_custkey % 2 = 0 then 6 end as max_length, ['a', 'b', o_orderpriority] as options, o_orderpriority as value from orders)"""


def field_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("source"), F.concat(F.lit("f"), (F.col("o_custkey") % 3).cast("string")).alias("name"), pick(FIELD_KINDS, F.col("o_orderkey")).alias("kind"),
        F.when(F.col("o_custkey") % 2 == 0, 6).alias("max_length"), F.array(F.lit("a"), F.lit("b"), "o_orderpriority").alias("options"), "o_orderpriority", "o_custkey",
    )


@query(f"with {FIELDS} select source, name, kind, case kind when 'text' then '' when 'check' then 'false' else '-' end as value from fields")
def blank_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    blank = forms.blank_values(field_table(spark, sf_dir))
    return blank.select("source", "name", "kind", F.coalesce(F.try_element_at("value", F.lit(1)), F.lit("-")).alias("value"))


@query(f"""with {FIELDS}, fills as (select source, case when source % 11 = 0 then 'nowhere' else name end as name, kind, max_length, value, source % 3 as way from fields),
given as (select *, case way when 0 then [value] when 1 then ['b', 'a', 'b'] else ['zzz'] end as v from fills)
select source, name, case when name <> 'nowhere' and kind = 'list' then array_to_string(list_sort(list_distinct(v)), ',') else array_to_string(v, ',') end as value,
  case when name = 'nowhere' then 'no such field' when kind = 'text' and max_length is not null and list_max([length(x) for x in v]) > max_length then 'too long'
    when kind in ('radio', 'combo', 'list') and way = 2 then 'not offered' when kind in ('radio', 'combo') and len(v) > 1 then 'one choice only' end as problem from given""")
def checked_form_fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = field_table(spark, sf_dir)
    way = F.col("source") % 3
    value = F.when(way == 0, F.array("o_orderpriority")).when(way == 1, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("zzz")))
    fills = fields.select("source", F.when(F.col("source") % 11 == 0, "nowhere").otherwise(F.col("name")).alias("name"), value.alias("value"))
    return forms.checked_fills(fields, fills).withColumn("value", F.array_join("value", ","))


SUBTYPES = ("Text", "Link", "Widget", "Popup", "Highlight", "FileAttachment", "Stamp", "Movie", "Odd")
ANNOTATIONS = f"""annotations as (select l_orderkey as source, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::integer as id,
  {listed(SUBTYPES)}[(l_partkey % 9 + 1)::integer] as subtype, (l_suppkey % 64)::integer as flags, l_quantity > 10 as has_appearance, l_returnflag = 'R' as stale, (l_partkey % 4 + 1)::integer as parent from lineitem)"""


def annotation_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("source"), F.row_number().over(order).alias("id"), pick(SUBTYPES, F.col("l_partkey")).alias("subtype"), (F.col("l_suppkey") % 64).cast("int").alias("flags"),
        (F.col("l_quantity") > 10).alias("has_appearance"), (F.col("l_returnflag") == "R").alias("stale"), (F.col("l_partkey") % 4 + 1).cast("int").alias("parent"),
    )


@query(f"""with {ANNOTATIONS} select source, id, case when subtype in ('Link', 'FileAttachment', 'Movie') then 'out of scope' when flags & 2 <> 0 or flags & 1 <> 0 or subtype = 'Popup' then 'removed'
  when flags & 32 <> 0 then 'on paper only' when not has_appearance or stale then 'kept' else 'drawn' end as status, (subtype = 'Widget')::integer as place from annotations""")
def flattened_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forms.flatten_status(annotation_table(spark, sf_dir)).select("source", "id", "status", F.col("order").alias("place"))


@query(f"with {ANNOTATIONS} select p.source, p.id from annotations p where p.subtype = 'Popup' and exists (select 1 from annotations g where g.source = p.source and g.id = p.parent and g.subtype = 'Highlight')")
def orphaned_popups(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = annotation_table(spark, sf_dir)
    return forms.orphaned_popups(a, a.where("subtype = 'Highlight'")).select("source", "id")


@query(f"with {ANNOTATIONS} select source, id, subtype from annotations where subtype <> 'Movie' and subtype <> 'Odd'")
def archived_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.clean_annotations(annotation_table(spark, sf_dir)).select("source", "id", "subtype")


@query("""with fonts as (select p_partkey % 50 as source, p_partkey as id, p_name as name, ['Type1', 'Type3', 'TrueType', 'Type0'][(p_size % 4 + 1)::integer] as subtype, case when p_size % 4 = 3 then p_partkey + 1 end as descendant from part),
programs as (select p_partkey % 50 as source, p_partkey as id from part where p_size > 20)
select distinct source, name from fonts f where subtype <> 'Type3' and not exists (select 1 from programs p where p.source = f.source and p.id = coalesce(f.descendant, f.id))""")
def unembedded_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts, k, size = read(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_size")
    fonts = parts.select((k % 50).alias("source"), k.alias("id"), F.col("p_name").alias("name"), pick(("Type1", "Type3", "TrueType", "Type0"), size).alias("subtype"), F.when(size % 4 == 3, k + 1).alias("descendant"))
    return forms.unembedded_fonts(fonts, parts.where("p_size > 20").select((k % 50).alias("source"), k.alias("id")))


@query("""with f as (select o_orderkey, o_orderkey % 13 = 0 as dynamic_form, o_custkey % 4 as attachments, case when o_orderkey % 2 = 0 then 2 else 3 end as part, o_custkey % 7 = 0 as lost, o_custkey % 5 as bare from orders)
select o_orderkey, case when dynamic_form then 'its form is dynamic' when attachments > 0 and part = 2 then 'it has attachments, which part 2 doesn''t take'
  when lost then 'fonts aren''t embedded: Arial, Zapf' when bare > 3 then 'a visible annotation has no appearance' end as reason from f""")
def archive_refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    lost = F.when(c % 7 == 0, F.array(F.lit("Zapf"), F.lit("Arial"))).otherwise(F.expr("cast(array() as array<string>)"))
    files = read(spark, sf_dir, "orders").select("o_orderkey", (k % 13 == 0).alias("dynamic_form"), (c % 4).alias("attachments"), F.when(k % 2 == 0, 2).otherwise(3).alias("part"), lost.alias("lost_fonts"), F.when(c % 5 > 3, 1).otherwise(0).alias("bare_annotations"))
    return archive.refusals(files).select("o_orderkey", "reason")


KEYS = ("Pages", "AA", "Metadata", "Perms", "Outlines")
ACTIONS = ("URI", "Launch", "Named", "JavaScript", "GoTo")


@query(f"""select o_orderkey, {listed(ACTIONS)}[(o_custkey % 5 + 1)::integer] in ('Launch', 'JavaScript') or ({listed(ACTIONS)}[(o_custkey % 5 + 1)::integer] = 'Named' and o_orderkey % 3 <> 0) as forbidden,
  case o_custkey % 3 when 0 then 'Screen' when 1 then 'Normal' else 'Multiply' end as blend, greatest(least(o_custkey * 10000000 - 3000000000, 2147483647), -2147483648)::integer as clamped,
  case when {listed(KEYS)}[(o_custkey % 5 + 1)::integer] in ('AA', 'Perms') then 'Type' else 'Type,' || {listed(KEYS)}[(o_custkey % 5 + 1)::integer] end as keys,
  case when o_custkey % 2 = 0 then '2,1,3' else '3,1,2' end as layers from orders""")
def archive_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Actions, blend modes, integers, catalogue keys and orders of layers as an archive holds them."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    modes = F.when(c % 3 == 0, F.array(F.lit("Odd"), F.lit("Screen"))).when(c % 3 == 1, F.array(F.lit("Odd"))).otherwise(F.array(F.lit("Multiply"), F.lit("Screen")))
    catalog = F.map_from_arrays(F.array(F.lit("Type"), pick(KEYS, c)), F.array(F.lit(0), F.lit(1)))
    order = F.when(c % 2 == 0, F.array(F.lit(2))).otherwise(F.array(F.lit(3), F.lit(1)))
    return read(spark, sf_dir, "orders").select(
        "o_orderkey", archive.is_forbidden_action(pick(ACTIONS, c), F.when(k % 3 == 0, "NextPage").otherwise("Odd")).alias("forbidden"), archive.blend_mode(modes).alias("blend"),
        archive.clamped(c * 10_000_000 - 3_000_000_000).alias("clamped"), F.array_join(F.map_keys(archive.clean_catalog(catalog)), ",").alias("keys"),
        F.array_join(archive.completed_order(order, F.array(F.lit(1), F.lit(2), F.lit(3))).cast("array<string>"), ",").alias("layers"),
    )


@query("""with c as (select l_orderkey as source, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)::integer as pos,
  coalesce(nullif(['A', 'B', ''][(l_partkey % 3 + 1)::integer], ''), 'Layers') as name from lineitem), n as (select *, row_number() over (partition by source, name order by pos) as k from c)
select source, pos, case when k = 1 then name else name || ' ' || k end as name from n""")
def layer_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    configs = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), F.row_number().over(order).alias("pos"), pick(("A", "B", ""), F.col("l_partkey")).alias("name"))
    return archive.unique_names(configs)


@query("""with p as (select l_orderkey as source, l_quantity > 25 as uses_rgb, l_discount > 0.05 as uses_cmyk, case when l_suppkey % 3 = 0 then 4 when l_suppkey % 3 = 1 and l_partkey % 4 = 0 then 3 end as intent_components from lineitem),
s as (select source, bool_or(uses_rgb) as rgb, bool_or(uses_cmyk) as cmyk, max(intent_components) as n from p group by source)
select source, case when n is null then 'sRGB' else 'kept' end as intent, rgb and coalesce(n, 3) <> 3 as default_rgb, cmyk and coalesce(n, 3) <> 4 as default_cmyk from s""")
def output_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, p = F.col("l_suppkey"), F.col("l_partkey")
    own = F.when(s % 3 == 0, 4).when((s % 3 == 1) & (p % 4 == 0), 3)
    pages = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("source"), (F.col("l_quantity") > 25).alias("uses_rgb"), (F.col("l_discount") > 0.05).alias("uses_cmyk"), own.alias("intent_components"))
    return archive.output_intent(pages)
