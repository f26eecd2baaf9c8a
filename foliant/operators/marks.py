"""Geometry of marks on pages: extents, moves, arrows, strokes, tiles, and folds over points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, SMOOTH = 30.0, 0.35


def extent(points: Column, reach: Column) -> Column:
    """The box of an array of structs x, y, grown by a stroke's reach and cut to the page."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    low = lambda v: F.greatest(F.array_min(v) - reach, F.lit(0.0))
    high = lambda v: F.least(F.array_max(v) + reach, F.lit(1.0))
    return F.struct(low(xs).alias("l"), low(ys).alias("t"), high(xs).alias("r"), high(ys).alias("b"))


def refit(points: Column, old: Column, new: Column) -> Column:
    """Points moved with their box from ``old`` to ``new``, axis by axis, kept on the page; a flat box moves without scaling."""

    def axis(v: Column, low: str, high: str) -> Column:
        size = old[high] - old[low]
        moved = F.when(size > 0, new[low] + (v - old[low]) / F.nullif(size, F.lit(0.0)) * (new[high] - new[low])).otherwise(v + new[low] - old[low])
        return F.least(F.greatest(moved, F.lit(0.0)), F.lit(1.0))

    return F.transform(points, lambda p: F.struct(axis(p["x"], "l", "r").alias("x"), axis(p["y"], "t", "b").alias("y")))


def moved(box: Column, dx: Column, dy: Column) -> Column:
    """A box moved as far as the page allows."""
    x = F.greatest(F.least(dx, 1 - box["r"]), -box["l"])
    y = F.greatest(F.least(dy, 1 - box["b"]), -box["t"])
    return F.struct((box["l"] + x).alias("l"), (box["t"] + y).alias("t"), (box["r"] + x).alias("r"), (box["b"] + y).alias("b"))


def arrow_head(x0: Column, y0: Column, x1: Column, y1: Column, width: Column) -> Column:
    """The two ends of an arrow's head: 30 degrees off the line, as long as three widths and four points."""
    angle, size = F.atan2(y1 - y0, x1 - x0), width * 3 + 4
    turn = lambda s: F.struct((x1 - size * F.cos(angle + s)).alias("x"), (y1 - size * F.sin(angle + s)).alias("y"))
    spread = F.radians(F.lit(HEAD))
    return F.array(turn(spread), turn(-spread))


def ink_widths(speeds: Column, thin: float, thick: float) -> Column:
    """Widths of a pen along a stroke: from thick to thin by speed (0 to 1), each mixed into the one before."""
    wanted = F.transform(speeds, lambda s: F.lit(thick) - (thick - thin) * F.least(F.greatest(s, F.lit(0.0)), F.lit(1.0)))
    empty = F.expr("cast(array() as array<double>)")
    last = lambda a, w: F.when(F.size(a) == 0, w).otherwise(F.try_element_at(a, F.lit(-1)))
    return F.aggregate(wanted, empty, lambda a, w: F.concat(a, F.array(last(a, w) + SMOOTH * (w - last(a, w)))))


def zigzag(l: Column, t: Column, r: Column, b: Column, step: float) -> Column:
    """A squiggly line under a box: points at even steps, down and up in turn."""
    height = (b - t) / 12
    n = F.greatest(F.ceil((r - l) / step), F.lit(1)).cast("int")
    return F.transform(F.sequence(F.lit(0), n), lambda i: F.struct(F.least(l + i * step, r).alias("x"), (b - F.when(i % 2 == 0, 0.0).otherwise(height)).alias("y")))


def tiles(frames: DataFrame, half_w: float, half_h: float, gap: float, most: int = 1000) -> DataFrame:
    """``source, page_no, x, y``: centres of a brick grid over each page, odd rows set off by half a step; more than ``most`` tiles are an error."""
    step_x, step_y = 2 * half_w + gap, 2 * half_h + gap
    columns, rows = F.floor(F.col("width") / step_x).cast("int") + 2, F.floor(F.col("height") / step_y).cast("int") + 2
    checked = F.when(columns * rows > most, F.raise_error(F.lit("too many tiles"))).otherwise(rows)
    grid = frames.withColumn("row", F.explode(F.sequence(F.lit(0), checked - 1))).withColumn("column", F.explode(F.sequence(F.lit(0), columns - 1)))
    x = F.col("column") * step_x - F.when(F.col("row") % 2 == 1, step_x / 2).otherwise(0.0)
    out = grid.select("source", "page_no", x.alias("x"), (F.col("row") * F.lit(step_y)).alias("y"), "width", "height")
    return out.where((F.col("x") > -half_w) & (F.col("x") < F.col("width") + half_w) & (F.col("y") < F.col("height") + half_h)).drop("width", "height")


def sync_points(anchors: DataFrame) -> DataFrame:
    """``key, a, b``: anchors in order of ``pos``, each kept only if it lies past the last kept one on both sides."""
    empty = F.expr("cast(array() as array<struct<a:double,b:double>>)")

    def step(kept: Column, p: Column) -> Column:
        last = F.try_element_at(kept, F.lit(-1))
        past = (F.size(kept) == 0) | ((p["a"] > last["a"]) & (p["b"] > last["b"]))
        return F.when(past, F.concat(kept, F.array(F.struct(p["a"].alias("a"), p["b"].alias("b"))))).otherwise(kept)

    per = anchors.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("pos", "a", "b"))).alias("ps"))
    return per.select("key", F.inline(F.aggregate("ps", empty, step)))


def number_text(value: Column) -> Column:
    """A number as files hold it: up to five decimals, without zeros at the end or a negative zero."""
    text = F.regexp_replace(F.format_string("%.5f", value), r"\.?0+$", "")
    return F.when(text.isin("-0", ""), "0").otherwise(text)
