"""Rules of archival files as tables: what is refused, what is taken out, what is normalised."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the archival standard.
FORBIDDEN_ACTIONS = ("Launch", "Sound", "Movie", "ResetForm", "ImportData", "Hide", "SetOCGState", "Rendition", "Trans", "GoTo3DView", "JavaScript")
PAGE_MOVES = ("NextPage", "PrevPage", "FirstPage", "LastPage")
ANNOTATIONS = (
    "Text", "Link", "FreeText", "Line", "Square", "Circle", "Polygon", "PolyLine", "Highlight", "Underline", "Squiggly", "StrikeOut", "Stamp", "Caret", "Ink", "Popup", "FileAttachment", "Widget", "PrinterMark", "TrapNet",
    "Watermark", "Redact",
)
BLEND_MODES = (
    "Normal", "Compatible", "Multiply", "Screen", "Overlay", "Darken", "Lighten", "ColorDodge", "ColorBurn", "HardLight", "SoftLight", "Difference", "Exclusion", "Hue", "Saturation", "Color", "Luminosity",
)
CATALOG_KEYS = ("Requirements", "Perms", "AA", "NeedsRendering", "Threads", "SpiderInfo")
LARGEST = (1 << 31) - 1


def is_forbidden_action(kind: Column, name: Column) -> Column:
    """Whether an action is out: a kind of the list, or a named one that is no page move."""
    return kind.isin(*FORBIDDEN_ACTIONS) | ((kind == "Named") & ~F.coalesce(name, F.lit("")).isin(*PAGE_MOVES))


def refusals(files: DataFrame) -> DataFrame:
    """``files`` with ``reason``: the first rule that makes a file impossible to convert; null where none does.

    Files hold ``dynamic_form, attachments, part, lost_fonts (array of names), bare_annotations``.
    """
    reason = (
        F.when(F.col("dynamic_form"), "its form is dynamic")
        .when((F.col("attachments") > 0) & (F.col("part") == 2), "it has attachments, which part 2 doesn't take")
        .when(F.size("lost_fonts") > 0, F.concat(F.lit("fonts aren't embedded: "), F.array_join(F.array_sort("lost_fonts"), ", ")))
        .when(F.col("bare_annotations") > 0, "a visible annotation has no appearance")
    )
    return files.withColumn("reason", reason)


def clean_catalog(dictionary: Column) -> Column:
    """A catalogue's map without keys that archives don't have."""
    return F.map_filter(dictionary, lambda k, v: ~k.isin(*CATALOG_KEYS))


def clean_annotations(annotations: DataFrame) -> DataFrame:
    return annotations.where(F.col("subtype").isin(*ANNOTATIONS))


def blend_mode(modes: Column) -> Column:
    """The first standard mode of an array; Normal without one."""
    return F.coalesce(F.try_element_at(F.filter(modes, lambda m: m.isin(*BLEND_MODES)), F.lit(1)), F.lit("Normal"))


def clamped(number: Column) -> Column:
    """Integers within 32 bits."""
    return F.greatest(F.least(number, F.lit(LARGEST)), F.lit(-LARGEST - 1)).cast("int")


def unique_names(configs: DataFrame) -> DataFrame:
    """``configs`` (source, pos, name) with names made unique: the first keeps its name, later ones get a number; nameless ones are called Layers."""
    named = configs.withColumn("name", F.coalesce(F.nullif("name", F.lit("")), F.lit("Layers")))
    n = F.row_number().over(Window.partitionBy("source", "name").orderBy("pos"))
    return named.withColumn("_n", n).withColumn("name", F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat("name", F.lit(" "), F.col("_n").cast("string")))).drop("_n")


def completed_order(order: Column, groups: Column) -> Column:
    """An order of layers with the groups it forgot at its end."""
    return F.concat(order, F.array_except(groups, order))


def output_intent(pages: DataFrame) -> DataFrame:
    """``source, intent, default_rgb, default_cmyk``: an intent that is there stays, else sRGB; device spaces with other components need a default space."""
    per = pages.groupBy("source").agg(F.bool_or("uses_rgb").alias("rgb"), F.bool_or("uses_cmyk").alias("cmyk"), F.max("intent_components").alias("n"))
    n = F.coalesce("n", F.lit(3))
    return per.select("source", F.when(F.col("n").isNotNull(), "kept").otherwise("sRGB").alias("intent"), (F.col("rgb") & (n != 3)).alias("default_rgb"), (F.col("cmyk") & (n != 4)).alias("default_cmyk"))
