"""Text as a reader finds it on a page: packed glyphs, searchable text, words at points, lines of boxes, recognised words."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import is_blank
from foliant.operators import spatial
from foliant.operators.spatial import PLACE

#: Recognised words are kept from this confidence on, readable ones from a lower one; a page with so many glyphs has text already.
SURE, READABLE, HAS_TEXT = 50, 20, 32


def packed(glyphs: DataFrame) -> DataFrame:
    """``source, page_no, text, ends, boxes``: a page's glyphs as one text with the end of each glyph's part of it, and four numbers a glyph."""
    upto = Window.partitionBy(*PLACE).orderBy("glyph_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = glyphs.withColumn("end", F.sum(F.length("text")).over(upto))
    per = rows.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("glyph_no", "text", "end", "l", "t", "r", "b"))).alias("gs"))
    part = lambda name: F.transform("gs", lambda g: g[name])
    boxes = F.flatten(F.transform("gs", lambda g: F.array(g["l"], g["t"], g["r"], g["b"])))
    return per.select(*PLACE, F.array_join(part("text"), "").alias("text"), part("end").alias("ends"), boxes.alias("boxes"))


def unpacked(pages: DataFrame) -> DataFrame:
    """``source, page_no, place, text, l, t, r, b``: the glyphs of packed pages, by place from 0; each text lies between two ends."""
    rows = pages.select(*PLACE, "text", "boxes", "ends", F.posexplode("ends").alias("place", "end"))
    start = F.when(F.col("place") == 0, 0).otherwise(F.try_element_at("ends", F.col("place")))
    box = [F.element_at("boxes", 4 * F.col("place") + i + 1).alias(c) for i, c in enumerate("ltrb")]
    return rows.select(*PLACE, "place", F.substring(F.col("text"), start + 1, F.col("end") - start).alias("text"), *box)


def searchable(glyphs: DataFrame) -> DataFrame:
    """``source, page_no, place, character, owner``: a page's text as it would be copied, in small letters, and the glyph of each character.

    A blank stands where a line ends or words are apart (owner -1); no blank follows a blank or comes first.
    """
    order = Window.partitionBy(*PLACE).orderBy("glyph_no")
    before, own = {c: F.lag(c).over(order) for c in "ltrb"}, {c: F.col(c) for c in "ltrb"}
    apart = F.coalesce(~spatial.same_line(before, own) | spatial.apart(before, own), F.lit(False))
    letters = F.filter(F.split(F.lower("text"), ""), lambda c: c != "")
    plain = F.transform(letters, lambda c: F.when(is_blank(c), " ").otherwise(c))
    rows = glyphs.withColumns({"apart": apart, "plain": plain})
    every = F.concat(F.when(F.col("apart"), F.array(F.lit(" "))).otherwise(F.array().cast("array<string>")), F.col("plain"))
    rows = rows.select(*PLACE, "glyph_no", "apart", F.posexplode(every).alias("at", "character"))
    inside = Window.partitionBy(*PLACE).orderBy("glyph_no", "at")
    kept = rows.withColumn("was", F.lag("character").over(inside)).where("character <> ' ' or was <> ' '")
    owner = F.when(F.col("apart") & (F.col("at") == 0), -1).otherwise(F.col("glyph_no"))
    return kept.select(*PLACE, (F.row_number().over(inside) - 1).alias("place"), "character", owner.alias("owner"))


def word_at(glyphs: DataFrame, points: DataFrame) -> DataFrame:
    """``source, page_no, point_no, text, l, t, r, b``: the whole word of the first glyph with ink that holds each point.

    Joins are merged and keep the glyphs dealt by page: Spark underrates exploded glyphs and would broadcast them.
    """
    numbered = spatial.word_numbers(glyphs)
    held = numbered.join(points.hint("merge"), PLACE).where("x between l and r and y between t and b")
    first = held.groupBy(*PLACE, "point_no").agg(F.min_by("word_no", "glyph_no").alias("first"))
    own = numbered.join(first.hint("merge"), PLACE).where("word_no = first")  # only glyphs of such words go on
    return spatial.joined(own, "point_no").select(*PLACE, "point_no", "text", "l", "t", "r", "b")


LINES = pa.list_(pa.struct([(c, pa.float64()) for c in "ltrb"]))


def line_boxes(glyphs: DataFrame) -> DataFrame:
    """``source, page_no, line_no, l, t, r, b``: boxes around a page's glyphs with ink, each with the first line whose first box it stands beside."""
    kind = glyphs.schema["source"].dataType.simpleString()
    own = glyphs.where(~is_blank(F.col("text")))
    per = own.groupBy(*PLACE).agg(F.array_sort(F.collect_list(F.struct("glyph_no", *[F.col(c).cast("double").alias(c) for c in "ltrb"]))).alias("gs"))

    def beside(a: dict, b: dict) -> bool:
        return abs((a["t"] + a["b"]) - (b["t"] + b["b"])) < max(a["b"] - a["t"], b["b"] - b["t"])

    def lines(boxes: list[dict]) -> list[dict]:
        out: list[tuple[dict, dict]] = []
        for box in boxes:
            for first, whole in out:
                if beside(first, box):
                    whole |= {"l": min(whole["l"], box["l"]), "t": min(whole["t"], box["t"]), "r": max(whole["r"], box["r"]), "b": max(whole["b"], box["b"])}
                    break
            else:
                out.append((box, {c: box[c] for c in "ltrb"}))
        return [whole for _, whole in out]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            found = pa.array([lines(gs) for gs in batch.column("gs").to_pylist()], LINES)
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("page_no"), found], [*PLACE, "ls"])

    found = per.mapInArrow(run, f"source {kind}, page_no int, ls array<struct<l: double, t: double, r: double, b: double>>")
    return found.select(*PLACE, F.posexplode("ls").alias("line_no", "box")).select(*PLACE, "line_no", "box.*")


def text_between(glyphs: DataFrame, first: int, last: int) -> DataFrame:
    """Line boxes of the glyphs between two numbers, whichever comes first."""
    return line_boxes(glyphs.where(F.col("glyph_no").between(min(first, last), max(first, last))))


def nearest_run(runs: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """``source, page_no, point_no, run_no, distance``: the nearest run of each point within ``reach``."""
    return spatial.nearest(runs.withColumnRenamed("run_no", "glyph_no"), points, reach).withColumnRenamed("glyph_no", "run_no")


def kept_words(words: DataFrame) -> DataFrame:
    """Recognised words (text, confidence) that are worth keeping: sure ones, and readable ones with a letter or digit."""
    readable = (F.col("confidence") >= READABLE) & F.col("text").rlike(r"[\p{L}\p{N}]")
    return words.where(~is_blank(F.col("text")) & ((F.col("confidence") >= SURE) | readable))


def is_drawable(text: Column, left: Column, width: Column, baseline: Column, size: Column, angle: Column) -> Column:
    """Whether a recognised word can be set on its page, in fractions of it, at less than an eighth of a turn."""
    finite = [~F.isnan(v) & (F.abs(v) < float("inf")) for v in (left, width, baseline, size, angle)]
    near = lambda v: (v >= -0.5) & (v < 1.5)
    out = text.rlike(r"[^\s\p{Cntrl}]") & (width > 0) & (size > 0) & (size <= 1) & (F.abs(angle) < math.pi / 4) & near(left) & near(baseline)
    for one in finite:
        out = out & one
    return F.coalesce(out, F.lit(False))


def unread_pages(pages: DataFrame, glyphs: DataFrame) -> DataFrame:
    """``pages`` that have too little text of their own to be passed over in recognition."""
    full = glyphs.groupBy(*PLACE).agg(F.count("*").alias("n")).where(F.col("n") >= HAS_TEXT)
    return pages.join(full, PLACE, "left_anti")
