"""Boxes on pages: coverage, lines, words, nearest glyphs. Areas are fractions of the page from the top left."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import is_blank

SHARE, CELLS = 0.25, 16
PLACE = ["source", "page_no"]


def binned(df: DataFrame, prefix: str, cells: int) -> DataFrame:
    """A row for each horizontal band of the page that a box reaches, so that joins meet boxes of one band only."""
    low, high = (F.least(F.greatest(F.floor(F.col(f"{prefix}{c}") * cells), F.lit(0)), F.lit(cells - 1)) for c in "tb")
    return df.withColumn("band", F.explode(F.sequence(low, F.greatest(low, high))))


def overlaps(glyphs: DataFrame, areas: DataFrame, cells: int = CELLS) -> DataFrame:
    """Per glyph: ``overlap``, the sum over boxes; ``centred``, whether a box holds its centre; ``inside``, whether one holds it whole.

    The join is by page and band; a pair that shares several bands counts in the first only. It is merged: Spark takes the size of
    exploded rows for that of the rows they come from, and would broadcast any number of glyphs.
    """
    a = areas.select(*PLACE, F.col("l").alias("al"), F.col("t").alias("at"), F.col("r").alias("ar"), F.col("b").alias("ab"))
    first = F.greatest(F.least(F.greatest(F.floor(F.col("t") * cells), F.lit(0)), F.lit(cells - 1)), F.least(F.greatest(F.floor(F.col("at") * cells), F.lit(0)), F.lit(cells - 1)))
    met = binned(glyphs, "", cells).join(binned(a, "a", cells).hint("merge"), [*PLACE, "band"]).where(F.col("band") == first)
    width = F.least("r", "ar") - F.greatest("l", "al")
    height = F.least("b", "ab") - F.greatest("t", "at")
    x, y = (F.col("l") + F.col("r")) / 2, (F.col("t") + F.col("b")) / 2
    return met.groupBy(*PLACE, "glyph_no").agg(
        F.sum(F.when((width > 0) & (height > 0), width * height).otherwise(0.0)).alias("overlap"),
        F.bool_or(x.between(F.col("al"), F.col("ar")) & y.between(F.col("at"), F.col("ab"))).alias("centred"),
        F.bool_or((F.col("l") >= F.col("al")) & (F.col("r") <= F.col("ar")) & (F.col("t") >= F.col("at")) & (F.col("b") <= F.col("ab"))).alias("inside"),
    )


def with_cover(glyphs: DataFrame, areas: DataFrame, share: float = SHARE) -> DataFrame:
    """``glyphs`` with ``covered`` (boxes together reach ``share`` of it; without an area: its centre lies in one) and ``inside``."""
    size = (F.col("r") - F.col("l")) * (F.col("b") - F.col("t"))
    joined = glyphs.join(overlaps(glyphs, areas).hint("merge"), [*PLACE, "glyph_no"], "left")
    covered = F.when(size <= 1e-12, F.coalesce("centred", F.lit(False))).otherwise(F.coalesce(F.col("overlap"), F.lit(0.0)) >= size * share)
    return joined.withColumns({"covered": covered, "inside": F.coalesce("inside", F.lit(False))}).drop("overlap", "centred")


def spilled(glyphs: DataFrame, areas: DataFrame) -> DataFrame:
    """Glyphs that go although no one box holds them whole."""
    return with_cover(glyphs, areas).where("covered and not inside").select(*glyphs.columns)


def kept(glyphs: DataFrame, areas: DataFrame) -> DataFrame:
    """Glyphs that a redaction leaves."""
    return with_cover(glyphs, areas).where("not covered").select(*glyphs.columns)


def fresh_words(words: DataFrame, glyphs: DataFrame, share: float = 0.5) -> DataFrame:
    """Recognised words of which text that is already there, blanks aside, covers less than ``share``."""
    there = glyphs.where(~is_blank(F.col("text")))
    return with_cover(words, there, share).where("not covered").select(*words.columns)


def unmarked(matches: DataFrame, marks: DataFrame, share: float = 0.98) -> DataFrame:
    """Matches that marks don't cover yet."""
    return with_cover(matches, marks, share).where("not covered").select(*matches.columns)


def same_line(b: dict[str, Column], a: dict[str, Column]) -> Column:
    taller = F.greatest(b["b"] - b["t"], a["b"] - a["t"])
    return F.abs((a["t"] + a["b"]) / 2 - (b["t"] + b["b"]) / 2) < taller / 2


def apart(before: dict[str, Column], after: dict[str, Column]) -> Column:
    return after["l"] - before["r"] > F.greatest(before["r"] - before["l"], after["r"] - after["l"]) / 3


def word_numbers(glyphs: DataFrame) -> DataFrame:
    """Glyphs with ink with ``line_no`` and ``word_no``: a new line, a gap or a blank ends a word. Both are counted over a page from 0."""
    order = Window.partitionBy(*PLACE).orderBy("glyph_no")
    before = {c: F.lag(c).over(order) for c in "ltrb"}
    own = {c: F.col(c) for c in "ltrb"}
    blank = is_blank(F.col("text"))
    marked = glyphs.withColumns({"new_line": F.coalesce(~same_line(before, own), F.lit(True)), "gap": F.coalesce(apart(before, own), F.lit(True)), "blank": blank, "was_blank": F.coalesce(F.lag(blank).over(order), F.lit(True))})
    marked = marked.withColumn("starts", ~F.col("blank") & (F.col("new_line") | F.col("gap") | F.col("was_blank")))
    run = order.rowsBetween(Window.unboundedPreceding, 0)
    numbered = marked.withColumns({"line_no": F.sum(F.col("new_line").cast("int")).over(run) - 1, "word_no": F.sum(F.col("starts").cast("int")).over(run) - 1})
    return numbered.where("not blank").select(*glyphs.columns, "line_no", "word_no")


def words(glyphs: DataFrame) -> DataFrame:
    """``source, page_no, line_no, word_no, text, l, t, r, b``: glyphs in order as words."""
    return joined(word_numbers(glyphs))


def joined(numbered: DataFrame, *by: str) -> DataFrame:
    """Numbered glyphs put together as words, for each of ``by`` besides."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("glyph_no", "text"))), lambda g: g["text"]), "")
    return numbered.groupBy(*PLACE, *by, "line_no", "word_no").agg(text.alias("text"), F.min("l").alias("l"), F.min("t").alias("t"), F.max("r").alias("r"), F.max("b").alias("b"))


def nearest(glyphs: DataFrame, points: DataFrame, reach: float) -> DataFrame:
    """``source, page_no, point_no, glyph_no, distance``: the nearest box of each point within ``reach``, the first of equals."""
    dx = F.greatest(F.col("l") - F.col("x"), F.col("x") - F.col("r"), F.lit(0.0))
    dy = F.greatest(F.col("t") - F.col("y"), F.col("y") - F.col("b"), F.lit(0.0))
    far = F.sqrt(dx * dx + dy * dy)
    met = points.hint("merge").join(glyphs, PLACE).withColumn("distance", far).where(F.col("distance") <= reach)
    return met.groupBy(*PLACE, "point_no").agg(F.min(F.struct("distance", "glyph_no")).alias("m")).select(*PLACE, "point_no", F.col("m.glyph_no").alias("glyph_no"), F.col("m.distance").alias("distance"))


def merged_intervals(spans: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, a, b``: spans of a key that touch or overlap as one; a missing end comes last and breaks nothing."""
    order = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("a"), F.asc_nulls_last("b"))
    reach = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.when(reach.isNull() | (F.col("a") > reach), 1).otherwise(0))
    return marked.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).groupBy(*keys, "island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("island")
