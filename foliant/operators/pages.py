"""Page algebra: ranges, splits, merges, reordering, numbering. Order is always a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def leading_int(text: Column) -> Column:
    """The number that a text begins with, after blanks and a sign; null without one."""
    return F.expr("try_cast(null as bigint)") if text is None else F.when(text.rlike(r"^\s*[+-]?[0-9]"), F.regexp_extract(text, r"^\s*([+-]?[0-9]{1,15})", 1).cast("bigint"))


def page_range(spec: Column, pages: Column) -> Column:
    """``1,3-5`` as a sorted array of distinct pages within the document; null if nothing is left. Odd parts are passed over."""
    none = F.expr("cast(array() as array<bigint>)")

    def part(p: Column) -> Column:
        cut = F.split(p, "-")
        low, high = leading_int(cut[0]), leading_int(F.try_element_at(cut, F.lit(2)))
        top = F.least(high, pages.cast("bigint"))
        run = F.when((low >= 1) & (high >= low) & (top >= low), F.sequence(low, top))
        one = leading_int(p)
        return F.coalesce(F.when(p.contains("-"), run).otherwise(F.when((one >= 1) & (one <= pages), F.array(one))), none)

    trimmed = F.filter(F.transform(F.split(spec, ","), lambda p: F.trim(p)), lambda p: p != "")
    found = F.array_sort(F.array_distinct(F.flatten(F.transform(trimmed, part))))
    return F.when((pages > 0) & (F.size(found) > 0), found)


def split_every(pages: DataFrame, n: int) -> DataFrame:
    """``pages`` with ``part`` from 0: chunks of ``n`` pages, the last one shorter."""
    if n < 1:
        raise ValueError("a part has one page at least")
    return pages.withColumn("part", F.floor((F.col("page_no") - 1) / n).cast("int"))


def split_ranges(pages: DataFrame, ranges: list[tuple[int, int]], combine: bool = False) -> DataFrame:
    """``source, part, pos, page_no``: the pages of each range in order; combined, one part where a page's first place counts.

    Ranges that end beyond a document are cut at its end; ranges of a table of documents can't be refused one by one.
    """
    if not ranges or any(low < 1 or high < low for low, high in ranges):
        raise ValueError("ranges run from 1, upwards")
    spec = F.array(*[F.struct(F.lit(i).alias("part"), F.lit(low).alias("low"), F.lit(high).alias("high")) for i, (low, high) in enumerate(ranges)])
    hits = pages.withColumn("r", F.explode(spec)).where(F.col("page_no").between(F.col("r.low"), F.col("r.high")))
    hits = hits.select("source", F.col("r.part").alias("part"), (F.col("page_no") - F.col("r.low")).alias("pos"), "page_no")
    if not combine:
        return hits
    first = hits.groupBy("source", "page_no").agg(F.min(F.struct("part", "pos")).alias("first"))
    order = Window.partitionBy("source").orderBy("first")
    return first.select("source", F.lit(0).alias("part"), (F.row_number().over(order) - 1).alias("pos"), "page_no")


def merge(pages: DataFrame) -> DataFrame:
    """``out_no, source, page_no``: documents one after another in the order of ``source``.

    Only the number of pages of each document is summed over all; pages are placed by adding their document's offset.
    """
    return pages.join(offsets(pages), "source").select((F.col("opens_at") + F.col("page_no") - 1).alias("out_no"), "source", "page_no")


def offsets(pages: DataFrame, per_slice: int = 1024) -> DataFrame:
    """``source, n, opens_at``: the page on which each document's bookmark opens in the merged file.

    Running sums go over ranges of sources: first over the sums of ranges, then within a range.
    """
    counts = pages.groupBy("source").agg(F.count("*").alias("n")).withColumn("slice", F.floor(F.col("source") / per_slice))
    over = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = counts.groupBy("slice").agg(F.sum("n").alias("all")).withColumn("before", F.coalesce(F.sum("all").over(over), F.lit(0)))
    inside = Window.partitionBy("slice").orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    return counts.join(slices, "slice").select("source", "n", (F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0)) + 1).alias("opens_at"))


def organize(pages: DataFrame, instructions: DataFrame) -> DataFrame:
    """``pos, source, page_no, rotate, width, height``: pages and blanks in the order of ``instructions``.

    An instruction (``pos, kind, source, page_no, turn, width, height``) places a page, turned on by ``turn``, or a
    blank of its own size. A page that isn't there, or is placed twice, is an error, and so is a turn that isn't a right angle.
    """
    placed = instructions.where("kind = 'page'").alias("i").join(pages.alias("p"), ["source", "page_no"], "left")
    times = Window.partitionBy("source", "page_no")
    wrong = F.when(F.col("p.rotate").isNull(), "no such page").when(F.count("*").over(times) > 1, "page placed twice").when(~F.col("turn").isin(0, 90, 180, 270), "turn is no right angle")
    turned = F.pmod(F.col("p.rotate") + F.col("turn"), F.lit(360))
    checked = placed.select("pos", "source", "page_no", F.when(wrong.isNull(), turned).otherwise(F.raise_error(F.coalesce(wrong, F.lit("")))).alias("rotate"), F.col("p.width").alias("width"), F.col("p.height").alias("height"))
    fits = F.col("width").between(1, 14400) & F.col("height").between(1, 14400)
    blank = instructions.where("kind = 'blank'").select(
        "pos", F.lit(None).cast(pages.schema["source"].dataType).alias("source"), F.lit(None).cast(pages.schema["page_no"].dataType).alias("page_no"),
        F.when(fits, F.pmod("turn", F.lit(360))).otherwise(F.raise_error(F.lit("blank of an impossible size"))).alias("rotate"), "width", "height",
    )
    return checked.unionByName(blank)


def extract(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    return pages.join(chosen, ["source", "page_no"], "left_semi")


def remove(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    return pages.join(chosen, ["source", "page_no"], "left_anti")


def number(pages: DataFrame, chosen: DataFrame, first: int = 1, form: str = "{n}/{total}") -> DataFrame:
    """``source, page_no, label`` for chosen pages: counted from ``first`` at the first chosen page; the total is the last one's number."""
    own = extract(pages, chosen)
    span = own.groupBy("source").agg(F.min("page_no").alias("low"), F.max("page_no").alias("high"))
    text = F.lit(form)
    n, total = F.lit(first) + F.col("page_no") - F.col("low"), F.lit(first) + F.col("high") - F.col("low")
    text = F.replace(F.replace(text, F.lit("{n}"), n.cast("string")), F.lit("{total}"), total.cast("string"))
    return own.join(span, "source").select("source", "page_no", text.alias("label"))


def crop(frame: DataFrame, least: float = 3.0) -> DataFrame:
    """``frame`` (width, height, and fractions l, t, r, b from the top left) with ``box`` in points from the bottom left, and ``whole``.

    An area keeps ``least`` points to a side and stays on the page; one within 1e-4 of the whole page is marked.
    """
    w, h = F.col("width"), F.col("height")
    x0, x1 = F.greatest(F.col("l") * w, F.lit(0.0)), F.least(F.col("r") * w, w)
    y0, y1 = F.greatest((1 - F.col("b")) * h, F.lit(0.0)), F.least((1 - F.col("t")) * h, h)
    x1, y1 = F.greatest(x1, x0 + least), F.greatest(y1, y0 + least)
    whole = (F.col("l") <= 1e-4) & (F.col("t") <= 1e-4) & (F.col("r") >= 1 - 1e-4) & (F.col("b") >= 1 - 1e-4)
    return frame.withColumns({"box": F.array(*[F.round(v, 3) for v in (x0, y0, x1, y1)]), "whole": whole})
