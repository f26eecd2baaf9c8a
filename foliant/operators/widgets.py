"""The tree of form fields and the widgets that show them. Nodes are rows of (source, id, parent, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators import graphs


def field_of(nodes: DataFrame) -> DataFrame:
    """``id, field``: a node with a name is its own field, else its parent is, where that is there; one step, not a climb."""
    parents = nodes.select(F.col("id").alias("above"))
    found = nodes.join(parents, nodes.parent == parents.above, "left")
    return found.select("id", F.when(F.col("name").isNotNull() | F.col("above").isNull(), F.col("id")).otherwise(F.col("above")).alias("field"))


def widgets_of(nodes: DataFrame) -> DataFrame:
    """``field, widget``: children that are widgets, or that have neither a name nor children; a field without children shows itself."""
    kids = nodes.select(F.col("parent").alias("field"), F.col("id").alias("widget"), "name", "is_widget")
    parents = nodes.select(F.col("parent").alias("has")).where("has is not null").distinct()
    shown = kids.join(nodes.select(F.col("id").alias("field")), "field").join(parents, F.col("widget") == F.col("has"), "left")
    shown = shown.where(F.col("is_widget") | (F.col("name").isNull() & F.col("has").isNull())).select("field", "widget")
    bare = nodes.join(parents, nodes.id == parents.has, "left_anti").select(F.col("id").alias("field"), F.col("id").alias("widget"))
    return shown.union(bare)


def has_value(nodes: DataFrame) -> DataFrame:
    """``id, filled``: the nearest node from a field upwards that has a value decides; an empty or null one is none.

    ``valued`` tells whether a node has a value at all, ``value`` is its array of texts or null.
    """
    own = nodes.withColumn("held", F.when(F.col("valued"), F.coalesce((F.size("value") > 0) & (F.array_join("value", "") != ""), F.lit(False))))
    return graphs.inherited(own, "held").select("id", F.coalesce("value", F.lit(False)).alias("filled"))


def pruned(nodes: DataFrame, removed: DataFrame) -> DataFrame:
    """The nodes that stay after ``removed`` widgets went: those from which children lead to a leaf that stays.

    Leaves that stay are the roots of a walk upwards, which stops at removed nodes.
    """
    left = nodes.join(removed.select("id"), "id", "left_anti")
    parents = nodes.select(F.col("parent").alias("id")).where("id is not null").distinct()
    leaves = left.join(parents, "id", "left_anti").select("id")
    up = left.where("parent is not null").select(F.col("id").alias("src"), F.col("parent").alias("dst")).join(left.select(F.col("id").alias("dst")), "dst", "left_semi")
    return left.join(graphs.reachable(up, leaves), "id", "left_semi")


def button_states(widgets: DataFrame) -> DataFrame:
    """``field, widget, shown``: what each widget of a button shows once ``chosen`` is set: the chosen one's state where it has that, else Off.

    ``states`` are a widget's looks (null for none, when only the chosen widget gets one), ``is_on`` whether the button goes on.
    """
    first = F.try_element_at(F.filter("states", lambda s: s != "Off"), F.lit(1))
    state = widgets.where("widget = chosen").select("field", F.coalesce(first, F.lit("Yes")).alias("state"))
    shows = F.col("is_on") & F.coalesce(F.array_contains("states", F.col("state")), F.col("widget") == F.col("chosen"))
    return widgets.join(state, "field").select("field", "widget", F.when(shows, F.col("state")).otherwise("Off").alias("shown"))


def needs_drawing(fields: DataFrame, widgets: DataFrame) -> DataFrame:
    """``field, draw``: text and choice fields that their form redraws, or that have a value and a widget without a normal appearance."""
    bare = widgets.groupBy("field").agg(F.bool_or(~F.col("has_normal")).alias("bare"))
    drawn = F.col("kind").isin("Tx", "Ch") & (F.col("redraws") | (F.col("filled") & F.coalesce("bare", F.lit(False))))
    return fields.join(bare, "field", "left").select("field", drawn.alias("draw"))


def options(raw: Column) -> Column:
    """(export, label) pairs from an array of options that are one text for both or an array of two."""
    return F.transform(raw, lambda o: F.struct(o[0].alias("export"), F.coalesce(F.try_element_at(o, F.lit(2)), o[0]).alias("label")))
