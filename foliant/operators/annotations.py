"""Annotations under boxes, their appearances and checks, ink and pictures of signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions import geometry
from foliant.operators import marks, measures

#: Flags of an annotation.
HIDDEN, NO_ROTATE, NO_VIEW = 2, 16, 32
#: What flattening leaves alone.
STAYS = ("Link", "Popup", "FileAttachment", "Movie", "Sound", "Screen", "3D", "RichMedia")
#: Light over this is paper, and ink fades into it over so many steps; ink is this far from paper at least, and this near to the farthest.
PAPER, FADE, FAR, NEAR_FARTHEST = 225, 60, 40, 0.8


def reach(rect: Column, points: Column) -> tuple[Column, Column]:
    """The rectangle (left, bottom, right, top) an annotation names, and the one around its points; null where there is none."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    around = F.struct(F.array_min(xs).alias("l"), F.array_min(ys).alias("b"), F.array_max(xs).alias("r"), F.array_max(ys).alias("t"))
    return rect, F.when(F.size(points) > 0, around)


def under(annotations: DataFrame, boxes: DataFrame) -> DataFrame:
    """``annotations`` (source, page_no, rect, points, subtype) that a box of their page overlaps, with ``last``: fields come after the rest.

    Either rectangle counts, one without an area by its corner; an annotation with neither is under them anyway.
    """
    named, drawn = reach(F.col("rect"), F.col("points"))
    rows = annotations.withColumns({"_named": named, "_drawn": drawn})
    box = boxes.select(F.col("source").alias("s"), F.col("page_no").alias("p"), *[F.col(c).alias(f"box_{c}") for c in "lbrt"])

    def meets(area: Column) -> Column:
        cross = (F.least(area["r"], "box_r") > F.greatest(area["l"], "box_l")) & (F.least(area["t"], "box_t") > F.greatest(area["b"], "box_b"))
        flat = ((area["r"] - area["l"]) * (area["t"] - area["b"]) == 0) & area["l"].between(F.col("box_l"), F.col("box_r")) & area["b"].between(F.col("box_b"), F.col("box_t"))
        return area.isNotNull() & F.coalesce(cross | flat, F.lit(False))

    nowhere = F.col("_named").isNull() & F.col("_drawn").isNull()
    met = rows.where(~nowhere).join(box, (F.col("source") == F.col("s")) & (F.col("page_no") == F.col("p")) & (meets(F.col("_named")) | meets(F.col("_drawn"))), "left_semi")
    return met.union(rows.where(nowhere)).select(*annotations.columns, (F.col("subtype") == "Widget").cast("int").alias("last"))


def remaining(annotations: DataFrame, boxes: DataFrame, pictured: DataFrame) -> DataFrame:
    """What redaction leaves: annotations no box overlaps, and on pages that became pictures only links of those."""
    gone = under(annotations, boxes).select("source", "page_no", "id")
    left = annotations.join(gone, ["source", "page_no", "id"], "left_anti")
    flag = pictured.select("source", "page_no").distinct().withColumn("_picture", F.lit(True))
    return left.join(flag, ["source", "page_no"], "left").where(F.col("_picture").isNull() | (F.col("subtype") == "Link")).drop("_picture")


def listed(annotations: DataFrame) -> DataFrame:
    """``source, page_no, ids``: each page's annotations in order, as the page lists them."""
    per = annotations.groupBy("source", "page_no").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("a"))
    return per.select("source", "page_no", F.transform("a", lambda x: x["id"]).alias("ids"))


def flatten_marks(annotations: DataFrame) -> DataFrame:
    """Annotations that flattening would draw: with an appearance, of a kind that goes, and visible."""
    visible = F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(HIDDEN | NO_VIEW)) == 0
    return annotations.where(F.col("has_appearance") & ~F.col("subtype").isin(*STAYS) & visible)


def removal_marks(annotations: DataFrame) -> DataFrame:
    """Visible annotations without an appearance, which redaction can only take away whole."""
    visible = F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(HIDDEN | NO_VIEW)) == 0
    return annotations.where(~F.col("has_appearance") & ~F.col("subtype").isin("Link", "Popup") & visible)


def chosen_state(stream: Column, states: Column, name: Column) -> Column:
    """The normal appearance: the stream itself, else the state that is named."""
    return F.coalesce(stream, F.try_element_at(states, name))


def placement(box: Column, matrix: Column, rect: Column, flags: Column, rotation: Column) -> Column:
    """The matrix that draws an appearance into its annotation's rectangle; null where one of them has no area.

    Of the box (l, b, r, t) turned by the form's matrix the bounds are fitted; with NoRotate the result is turned back about the top left corner.
    """
    corners = [geometry.transformed(matrix, box[x], box[y]) for x in "lr" for y in "bt"]
    left, right = F.least(*[c["x"] for c in corners]), F.greatest(*[c["x"] for c in corners])
    low, high = F.least(*[c["y"] for c in corners]), F.greatest(*[c["y"] for c in corners])
    x, y = F.try_divide(rect["r"] - rect["l"], right - left), F.try_divide(rect["t"] - rect["b"], high - low)
    fit = F.array(x, F.lit(0.0), F.lit(0.0), y, rect["l"] - left * x, rect["b"] - low * y)
    angle = F.radians(rotation.cast("double"))
    sin, cos = F.sin(angle), F.cos(angle)
    turn = F.array(cos, sin, -sin, cos, rect["l"] - rect["l"] * cos + rect["t"] * sin, rect["t"] - rect["l"] * sin - rect["t"] * cos)
    upright = (flags.bitwiseAND(F.lit(NO_ROTATE)) == 0) | (rotation == 0)
    whole = (right > left) & (high > low) & (rect["r"] > rect["l"]) & (rect["t"] > rect["b"])
    return F.when(whole, F.when(upright, fit).otherwise(geometry.multiply(fit, turn)))


def problem(annotations: DataFrame) -> DataFrame:
    """``annotations`` with ``problem``: why one can't be put on its page; null if it can.

    ``kind`` is markup, ink, shape, line, text, note or image; ``points`` are its corners or places in fractions of the page.
    """
    on_page = lambda v: v.between(0, 1)
    inside = F.forall("points", lambda p: on_page(p["x"]) & on_page(p["y"]))
    first, last = F.col("points")[0], F.try_element_at("points", F.lit(-1))
    area = inside & (F.size("points") == 2) & (first["x"] < last["x"]) & (first["y"] < last["y"])
    pen = F.col("width").between(0.1, 100)
    fits = (
        F.when(F.col("kind") == "markup", area)
        .when(F.col("kind") == "shape", area & pen)
        .when(F.col("kind") == "ink", (F.size("points") > 0) & inside & pen)
        .when(F.col("kind") == "line", inside & pen & ((first["x"] != last["x"]) | (first["y"] != last["y"])))
        .when(F.col("kind") == "text", area & F.col("size").between(1, 1000))
        .when(F.col("kind") == "note", inside)
        .otherwise(on_page(first["x"]) & on_page(first["y"]) & (F.col("width") > 0) & (F.col("width") <= 1))
    )
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    why = (
        F.when(~F.forall("color", on_page), "no valid color")
        .when(~((F.col("opacity") > 0) & (F.col("opacity") <= 1)), "no valid opacity")
        .when((F.col("kind") == "text") & empty, "an empty text box")
        .when((F.col("kind") == "note") & F.col("flatten"), "a note can't be drawn")
        .when((F.col("kind") == "note") & empty, "an empty note")
        .when(~F.coalesce(fits, F.lit(False)), "not on the page")
    )
    return annotations.withColumn("problem", why)


def packed_strokes(strokes: Column) -> Column:
    """Strokes (arrays of points) as one array of numbers, with NaN after each stroke."""
    flat = F.transform(strokes, lambda s: F.concat(F.flatten(F.transform(s, lambda p: F.array(p["x"], p["y"]))), F.array(F.lit(float("nan")))))
    return F.flatten(flat)


def smoothed(points: Column) -> Column:
    """Quadratic curves through the middles between a stroke's points: each inner point steers towards the middle to the next one."""
    inner = F.slice(points, 2, F.greatest(F.size(points) - 2, F.lit(0)))
    return F.transform(inner, lambda p, i: F.struct(p["x"].alias("cx"), p["y"].alias("cy"), ((p["x"] + points[i + 2]["x"]) / 2).alias("x"), ((p["y"] + points[i + 2]["y"]) / 2).alias("y")))


def scaled(points: Column, factor: float) -> Column:
    """Points scaled about the centre of their box, as far as the page allows; growth that doesn't fit leaves them as they are."""
    box = marks.extent(points, F.lit(0.0))
    cx, cy = (box["l"] + box["r"]) / 2, (box["t"] + box["b"]) / 2
    half_w, half_h = (box["r"] - box["l"]) / 2 * factor, (box["b"] - box["t"]) / 2 * factor
    room = lambda c, half: F.when(half > 0, F.least(c, 1 - c) / F.nullif(half, F.lit(0.0))).otherwise(F.lit(float("inf")))
    fits = F.least(room(cx, half_w), room(cy, half_h), F.lit(1.0))
    new = F.struct((cx - half_w * fits).alias("l"), (cy - half_h * fits).alias("t"), (cx + half_w * fits).alias("r"), (cy + half_h * fits).alias("b"))
    return F.when((fits < 1) & F.lit(factor > 1), points).otherwise(marks.refit(points, box, new))


def ink_alpha(r: Column, g: Column, b: Column, alpha: Column) -> Column:
    """How opaque a pixel of a scanned signature stays: light paper fades out, with a soft edge."""
    shown = F.least(F.greatest((PAPER - F.least(r, g, b)) / F.lit(float(FADE)), F.lit(0.0)), F.lit(1.0))
    return F.floor(alpha * shown + 0.5).cast("int")


def ink_and_paper(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, red, green, blue`` of the paper and ``ink_red, ink_green, ink_blue``: the mean of the pixels that are almost farthest from it, black if none is far."""
    paper = measures.common_color(pixels, keys).drop("n")
    apart = F.sqrt(sum(((F.col(c) - F.col(name)) * (F.col(c) - F.col(name)) for c, name in (("g", "green"), ("b", "blue"))), (F.col("r") - F.col("red")) * (F.col("r") - F.col("red"))))
    away = pixels.join(F.broadcast(paper) if not keys else paper, keys).withColumn("away", apart)
    farthest = away.groupBy(*keys).agg(F.max("away").alias("far"))
    inked = away.join(farthest, keys).where((F.col("far") >= FAR) & (F.col("away") >= F.col("far") * NEAR_FARTHEST))
    ink = inked.groupBy(*keys).agg(*[F.floor(F.avg(c) + 0.5).cast("int").alias(f"ink_{n}") for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))])
    return paper.join(ink, keys, "left").select(*paper.columns, *[F.coalesce(f"ink_{n}", F.lit(0)).alias(f"ink_{n}") for n in ("red", "green", "blue")])


def signature_box(left: Column, top: Column, width: Column, page_w: Column, page_h: Column, aspect: Column) -> Column:
    """Where an image of a signature stands in points from the bottom left: its place and width are fractions of the page, its height follows."""
    w = width * page_w
    return F.struct((left * page_w).alias("l"), (page_h - top * page_h - w * aspect).alias("b"), (left * page_w + w).alias("r"), (page_h - top * page_h).alias("t"))


def appearances(annotations: DataFrame) -> DataFrame:
    """``id, stream, matrix`` of annotations that flattening can draw: shown, no popup, with a normal appearance that fits its rectangle."""
    shown = (F.coalesce(F.col("flags"), F.lit(0)).bitwiseAND(F.lit(HIDDEN | NO_VIEW)) == 0) & (F.col("subtype") != "Popup")
    drawn = annotations.where(shown).withColumn("stream", chosen_state(F.col("stream"), F.col("states"), F.col("state")))
    placed = drawn.withColumn("matrix", placement(F.col("box"), F.col("form_matrix"), F.col("rect"), F.coalesce("flags", F.lit(0)), F.col("rotation")))
    return placed.where("stream is not null and matrix is not null").select("id", "stream", "matrix")


def undescribed(elements: DataFrame, touched: DataFrame) -> DataFrame:
    """``elements`` (source, page_no, mark, entries) without what they say of content that was taken out (source, page_no, mark)."""
    flag = touched.select("source", "page_no", "mark").distinct().withColumn("_gone", F.lit(True))
    plain = F.map_filter("entries", lambda k, v: ~k.isin("ActualText", "Alt", "E"))
    joined = elements.join(flag, ["source", "page_no", "mark"], "left")
    return joined.withColumn("entries", F.when(F.col("_gone"), plain).otherwise(F.col("entries"))).drop("_gone")
