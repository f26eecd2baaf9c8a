"""Mixing sources to target weights by capped water-filling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import WORD, durable, small

#: DIGITS: of the draws, by which slices are found.
WEIGHTS, SHARE, EPOCHS, SEED, DIGITS = (5, 2, 1), 1.5, 2, 17, (2, 5)


def words(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: int) -> Column:
    """A document's place in the seeded order of its source: an MD5 in hex; a null id reads as empty."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``source, size``: one row for each source, null included.

    Water-filling: with sources in the order of cap / weight, those under the water level are clamped
    at ``epochs`` times their size, and the level of the others is what is left by weight. The level is
    found from running sums over the table of sources, which holds one row for a source and is the
    only thing that meets in one place.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", cycle.cast("long")).withColumn("cap", F.col("source_size") * epochs)
    rank = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = rank.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    per = per.withColumns({
        "all_size": F.sum("source_size").over(whole),
        "all_weight": F.sum("weight").over(whole),
        "cap_before": F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_before": F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    # The level if exactly the sources before this one are clamped; the first source that it doesn't fill stops the rise.
    level = (F.col("all_size") * F.lit(float(share)) - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before"))
    per = per.withColumn("level", level)
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    final = F.coalesce(F.first(open_, ignorenulls=True).over(rank.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(float("inf")))
    return per.withColumn("final", final).select(
        "source", "source_size", F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")).alias("target")
    )


def narrowed(rows: DataFrame, ends: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """``rows`` in the slice of draws (by their first hex digits) in which their source's fractional repetition ends, and ``ends`` for these.

    ``ends`` holds ``s`` (a source), ``left`` (words to take), ``below`` (words of all lower slices) and ``slice``.
    """
    slices = rows.groupBy("source", F.substring("draw", 1, digits).alias("part")).agg(F.sum("size").alias("part_size"))
    up_to = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("under", F.coalesce(F.sum("part_size").over(up_to), F.lit(0)))
    last = slices.join(ends, F.col("source").eqNullSafe(F.col("s"))).where(F.col("below") + F.col("under") < F.col("left"))
    last = last.groupBy("s", "left").agg(F.max(F.struct("part", (F.col("below") + F.col("under")).alias("below"))).alias("m"))
    last = small(durable(last.select("s", "left", F.col("m.below").alias("below"), F.col("m.part").alias("slice"))))
    inside = rows.join(last, F.col("source").eqNullSafe(F.col("s")) & (F.substring("draw", 1, digits) == F.col("slice")))
    return inside.select(*rows.columns), last


def plan(sizes: DataFrame, per: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """``per`` with ``repeats`` (whole repetitions) and ``edge``, the last draw that is taken once more.

    In a source the documents with the lowest draws make up the fractional repetition, as far as its
    words come nearest to what is left of the target. Sums by the first hex digits of the draw find the
    one slice in which it ends, those by more digits the slice of that, and only this one is put in order:
    a source has a 256th and then a millionth of its rows in one place, and 4096 sums.
    """
    left = F.greatest(F.col("target") - F.col("repeats") * F.col("source_size"), F.lit(0.0))
    whole = F.least(F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)).cast("long"), F.lit(epochs).cast("long"))
    per = small(durable(per.withColumn("repeats", whole).withColumn("left", left)))
    rows, ends = sizes.select("source", "size", "draw"), per.select(F.col("source").alias("s"), "left", F.lit(0).cast("long").alias("below"), F.lit("").alias("slice"))
    for digits in DIGITS:
        rows, ends = narrowed(rows, ends, digits)
    run = Window.partitionBy("source").orderBy("draw", "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.join(ends, F.col("source").eqNullSafe(F.col("s"))).withColumn("at", F.col("below") + F.coalesce(F.sum("size").over(run), F.lit(0)))
    taken = F.when(2 * F.col("at") + F.col("size") <= 2 * F.col("left"), F.col("draw"))
    edge = inside.groupBy("source").agg(F.coalesce(F.max(taken), F.min("slice")).alias("edge"))
    edge = edge.select(F.col("source").alias("s"), "edge")
    return per.join(edge, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "repeats", "edge")


def planned(docs: DataFrame, weights, share: float, epochs: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """``doc_id, source, size, draw`` of all rows, and ``of``, the plan of each source. Words are counted once."""
    sizes = durable(docs.select("doc_id", "source", words(F.col("text")).alias("size"), draw(F.col("doc_id"), seed).alias("draw")))
    per = plan(sizes, targets(sizes, weights, share, epochs), epochs)
    return sizes, small(durable(per.select(F.struct("*").alias("of"))))


def times() -> Column:
    """How often the mix takes a row with ``draw``, by its source's plan."""
    return (F.col("of.repeats") + F.when(F.col("draw") <= F.col("of.edge"), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``row, times`` for each row of ``docs``: all its columns in a struct, and how often the mix takes it.

    Empty and null texts have size 0 and change nothing; a source of such texts has target 0. A null
    source is a source of its own, the last in order. Rows that share a doc_id have the same draw and
    are taken alike, as are repeated rows. An empty table gives an empty result. Columns of ``docs`` may have any
    names. Texts of any length are counted whole. The table of sources, a row each, is worked out in one place.
    """
    _, per = planned(docs, weights, share, epochs, seed)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", draw(F.col("doc_id"), seed).alias("draw"))
    return rows.join(per, F.col("source").eqNullSafe(F.col("of.source"))).select("row", times().alias("times"))


def digest(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of ``docs``, as ``mix`` takes it."""
    sizes, per = planned(docs, weights, share, epochs, seed)
    out = sizes.join(per, F.col("source").eqNullSafe(F.col("of.source")))
    return out.select("doc_id", "size", F.col("of.source_size").alias("source_size"), F.col("of.target").alias("target"), (F.col("size") * times()).alias("taken"))
