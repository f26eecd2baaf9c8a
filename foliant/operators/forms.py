"""Forms, annotations and fonts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def changed_fields(fields: DataFrame, values: DataFrame) -> DataFrame:
    """``source, name, kind, value`` of fields whose value differs from the one they came with; null and missing are alike."""
    new = values.select("source", "name", F.col("value").alias("new"))
    return fields.join(new, ["source", "name"]).where(~F.col("value").eqNullSafe(F.col("new"))).select("source", "name", "kind", F.col("new").alias("value"))


def blank_values(fields: DataFrame) -> DataFrame:
    """The empty value of each field by kind: an empty text, an unset flag, no choice."""
    empty = F.expr("cast(array() as array<string>)")
    return fields.select("source", "name", "kind", F.when(F.col("kind") == "text", F.array(F.lit(""))).when(F.col("kind") == "check", F.array(F.lit("false"))).otherwise(empty).alias("value"))


def checked_fills(fields: DataFrame, fills: DataFrame) -> DataFrame:
    """``fills`` with ``problem``: unknown field, text over its length, or a choice that isn't offered; null if all is well."""
    own = fields.select("source", "name", "kind", "max_length", "options")
    joined = fills.join(own, ["source", "name"], "left")
    longest = F.array_max(F.transform("value", lambda v: F.length(v)))
    offered = F.size(F.array_except("value", F.coalesce("options", F.expr("cast(array() as array<string>)")))) == 0
    problem = (
        F.when(F.col("kind").isNull(), "no such field")
        .when((F.col("kind") == "text") & F.col("max_length").isNotNull() & (longest > F.col("max_length")), "too long")
        .when(F.col("kind").isin("radio", "combo", "list") & ~offered, "not offered")
        .when(F.col("kind").isin("radio", "combo") & (F.size("value") > 1), "one choice only")
    )
    return joined.select("source", "name", F.when(F.col("kind") == "list", F.array_sort(F.array_distinct("value"))).otherwise(F.col("value")).alias("value"), problem.alias("problem"))


#: Flags of an annotation.
INVISIBLE, HIDDEN, PRINT, NO_VIEW = 1, 2, 4, 32


def flatten_status(annotations: DataFrame, forms_only: bool = False) -> DataFrame:
    """``annotations`` with ``status`` and ``order``: what flattening does with each, fields after the others.

    Links and carriers of files or media stay out of it; hidden ones go without being drawn; those without an
    appearance, or with a stale one, are kept; the rest are drawn into the page.
    """
    flag = lambda bit: F.col("flags").bitwiseAND(F.lit(bit)) != 0
    field = F.col("subtype") == "Widget"
    stays = F.col("subtype").isin("Link", "FileAttachment", "Movie", "Sound", "Screen", "3D", "RichMedia")
    status = (
        F.when(stays | (F.lit(forms_only) & ~field), "out of scope")
        .when(flag(HIDDEN) | flag(INVISIBLE) | (F.col("subtype") == "Popup"), "removed")
        .when(flag(NO_VIEW), "on paper only")
        .when(~F.col("has_appearance") | F.coalesce("stale", F.lit(False)), "kept")
        .otherwise("drawn")
    )
    return annotations.withColumns({"status": status, "order": field.cast("int")})


def orphaned_popups(annotations: DataFrame, removed: DataFrame) -> DataFrame:
    """Popups whose parent was removed; they go too."""
    return annotations.where("subtype = 'Popup'").join(removed.select(F.col("source"), F.col("id").alias("parent")), ["source", "parent"], "left_semi")


def unembedded_fonts(fonts: DataFrame, programs: DataFrame) -> DataFrame:
    """Names of fonts without a font program, in order; Type 3 fonts draw themselves, and composite ones rest on their descendant."""
    of = F.coalesce("descendant", "id")
    used = fonts.where("subtype <> 'Type3'").withColumn("id", of)
    return used.join(programs, ["source", "id"], "left_anti").select("source", "name").distinct().orderBy("source", "name")


def repair_report(warnings: DataFrame, classes: list[tuple[str, str]]) -> DataFrame:
    """``source, kind, n``: warnings by the first of ``classes`` (kind, pattern) that they match, in that order; kinds without any are left out."""
    kind = F.coalesce(*[F.when(F.col("warning").rlike(pattern), name) for name, pattern in classes])
    place = F.coalesce(*[F.when(F.col("kind") == name, i) for i, (name, _) in enumerate(classes)])
    counts = warnings.withColumn("kind", kind).where("kind is not null").groupBy("source", "kind").agg(F.count("*").alias("n"))
    return counts.withColumn("place", place)
