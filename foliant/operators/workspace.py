"""Files as a front end lists them: keys, order, types, sizes; what is stripped from them; several put together; texts through a model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.codecs import packed, smaller
from foliant.functions.text import nfkc, squeeze, xml_escape, xmp_date
from foliant.operators import measures, pages

#: Keys that archives don't hold, by the kind of dictionary (any: in all).
FORBIDDEN_KEYS = (("any", "Metadata"), ("any", "AA"), ("any", "Alternates"), ("any", "OPI"), ("form", "XFA"), ("form", "NeedAppearances"), ("catalog", "OpenAction"), ("image", "Interpolate"), ("annotation", "A"))
#: Fields of a file's information and their names as metadata, in the order written.
INFORMATION = (("Title", "dc:title"), ("Author", "dc:creator"), ("Subject", "dc:description"), ("Keywords", "pdf:Keywords"), ("Creator", "xmp:CreatorTool"), ("Producer", "pdf:Producer"), ("CreationDate", "xmp:CreateDate"), ("ModDate", "xmp:ModifyDate"))


def source_key(name: Column, size: Column, modified: Column) -> Column:
    return F.concat_ws("\0", name, size.cast("string"), modified.cast("string"))


def moved(files: DataFrame, start: int, to: int) -> DataFrame:
    """``files`` with ``pos`` as after taking out the file at ``start`` and putting it in at ``to``."""
    pos = F.col("pos")
    if start < to:
        shift = F.when(pos.between(start + 1, to), pos - 1)
    else:
        shift = F.when(pos.between(to, start - 1), pos + 1)
    return files.withColumn("pos", F.when(pos == start, to).otherwise(F.coalesce(shift, pos)).cast(files.schema["pos"].dataType))


def nearest_first(rows: DataFrame, first: int) -> DataFrame:
    """``rows`` (source, page_no) with ``turn``: pages nearest to one of them come first, of equals the earlier."""
    order = Window.partitionBy("source").orderBy(F.abs(F.col("page_no") - first), "page_no")
    return rows.withColumn("turn", F.row_number().over(order) - 1)


def accepted(files: DataFrame, endings: list[str]) -> tuple[DataFrame, DataFrame]:
    """Files with one of the endings, and ``skipped``, the number of the others, by job."""
    fits = F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).isin(*endings)
    return files.where(fits), files.groupBy("job").agg(F.count_if(~fits).alias("skipped"))


def total_sizes(parts: DataFrame, key: str) -> DataFrame:
    """``key, size, parts``: what is stored or has to be loaded for each key."""
    return parts.groupBy(key).agg(F.sum("size").alias("size"), F.count("*").alias("parts"))


def stripped(dictionary: Column, *names: str) -> Column:
    return F.map_filter(dictionary, lambda k, v: ~k.isin(*names))


def cleaned_entries(entries: DataFrame) -> DataFrame:
    """Entries of dictionaries (object, kind, key, value) without those that an archive doesn't hold."""
    rules = entries.sparkSession.createDataFrame(FORBIDDEN_KEYS, "rule_kind string, rule_key string")
    return entries.join(F.broadcast(rules), (F.col("key") == F.col("rule_key")) & F.col("rule_kind").isin(F.lit("any"), F.col("kind")), "left_anti")  # a fixed table of rules


def attachments(specifications: DataFrame) -> DataFrame:
    """``source, files``: every file specification that holds a file, in order, as the catalogue lists them."""
    per = specifications.where("holds_file").groupBy("source").agg(F.array_sort(F.collect_set("id")).alias("files"))
    return per


def metadata(information: Column, part: int) -> Column:
    """A file's information (a map) as metadata text; empty fields and dates that can't be read are left out."""
    rows = [F.concat(F.lit(f"<pdfaid:part>{part}</pdfaid:part><pdfaid:conformance>B</pdfaid:conformance>"))]
    for name, tag in INFORMATION:
        raw = F.try_element_at(information, F.lit(name))
        value = xmp_date(raw) if tag.endswith("Date") else F.nullif(F.trim(raw), F.lit(""))
        rows.append(F.coalesce(F.concat(F.lit(f"<{tag}>"), xml_escape(value), F.lit(f"</{tag}>")), F.lit("")))
    return F.concat(*rows)


def assembled(objects: DataFrame, refs: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Objects and references of several files as one file's: each file's ids are moved past those of the files before it.

    ``sources`` (source, pos) tells which files come in what order; a file that is not among them is left out.
    """
    most = objects.groupBy("source").agg(F.max("id").alias("most")).join(sources, "source")
    over = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    shift = most.select("source", F.coalesce(F.sum("most").over(over), F.lit(0)).alias("shift"))
    kept = objects.join(shift, "source").withColumn("id", F.col("id") + F.col("shift")).drop("shift")
    moved_refs = refs.join(shift, "source").select("source", (F.col("src") + F.col("shift")).alias("src"), (F.col("dst") + F.col("shift")).alias("dst"))
    return kept, moved_refs


def assembled_pages(frames: DataFrame, sources: DataFrame) -> DataFrame:
    """``out_no, source, page_no`` and each page's inherited attributes, written to the page itself, in the order of ``sources``."""
    placed = frames.join(sources, "source").withColumn("file", F.col("pos"))
    merged = pages.merge(placed.select(F.col("file").alias("source"), "page_no"))
    return merged.select("out_no", F.col("source").alias("file"), "page_no").join(placed, ["file", "page_no"]).drop("file", "pos")


def model_pairs(start: Column, to: Column) -> Column:
    """The models that take one language to another: one with English on either side, else two; none for the same or an unknown language."""
    way = lambda a, b: F.concat(a, F.lit("-"), b)
    none = F.array().cast("array<string>")
    return (
        F.when(start.isNull() | to.isNull() | (start == to), none)
        .when((start == "en") | (to == "en"), F.array(way(start, to)))
        .otherwise(F.array(way(start, F.lit("en")), way(F.lit("en"), to)))
    )


def unchanged(original: Column, changed: Column) -> Column:
    """Whether two texts differ in forms of characters, white space and case at most."""
    plain = lambda t: squeeze(F.lower(nfkc(t)))
    return plain(original) == plain(changed)


def translated(blocks: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """``blocks`` with ``translation`` by ``model``, a column function, which reads each distinct text once; null where it changed nothing."""
    texts = blocks.select("text").distinct()
    known = texts.select("text", model(F.col("text")).alias("translation"))
    out = blocks.join(known, "text", "left")
    return out.withColumn("translation", F.when(~unchanged(F.col("text"), F.col("translation")), F.col("translation"))).select(*blocks.columns, "translation")


def pivoted(blocks: DataFrame, models: dict[str, Callable[[Column], Column]], start: str, to: str) -> DataFrame:
    """``translated`` through the one or two models between two languages."""
    names = [f"{start}-{to}"] if "en" in (start, to) else [f"{start}-en", f"en-{to}"]
    steps = [models[n] for n in names if start != to]

    def through(text: Column) -> Column:
        for step in steps:
            text = step(text)
        return text

    return translated(blocks, through)


def summary_notes(parts: DataFrame, model: Callable[[Column], Column]) -> DataFrame:
    """``doc_id, part_no, note``: what a model, a column function, says of each part; the parts' notes are then ranked and joined by others."""
    whole = parts.groupBy("doc_id", "part_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("par_no", "piece"))), lambda p: p["piece"]), "\n\n").alias("text"))
    return whole.select("doc_id", "part_no", model(F.col("text")).alias("note"))


def even_sizes(blocks: DataFrame) -> DataFrame:
    """``blocks`` (page, family, bold, size, fitted) with ``shown``: the size of a kind's blocks is cut to the kind's median share, where two or more were fitted."""
    keys = ["page", "family", "bold", "half"]
    rows = blocks.withColumns({"half": F.floor(F.col("size") * 2 + 0.5), "share": F.col("fitted") / F.col("size")})
    median = measures.upper_median(rows, keys, "share")
    several = rows.groupBy(*keys).agg(F.count("fitted").alias("n"))
    out = rows.join(several, keys).join(median, keys, "left")
    most = F.col("size") * F.col("median")
    return out.select(*blocks.columns, F.when((F.col("n") >= 2) & (F.col("fitted") > most + 0.01), most).otherwise(F.col("fitted")).alias("shown"))


def stamp_place(width: Column, height: Column, stamp_w: Column, stamp_h: Column, position: Column, rotation: Column, margin: float) -> Column:
    """The centre of a turned stamp at one of nine places of a page, from the top left; it keeps its margin from the edges it stands at."""
    angle = F.radians(rotation)
    sin, cos = F.abs(F.sin(angle)), F.abs(F.cos(angle))
    half_w, half_h = (stamp_w * cos + stamp_h * sin) / 2, (stamp_w * sin + stamp_h * cos) / 2
    across, down = position % 3, F.floor(position / 3)
    x = F.when(across == 0, margin + half_w).when(across == 2, width - margin - half_w).otherwise(width / 2)
    y = F.when(down == 0, height - margin - half_h).when(down == 2, margin + half_h).otherwise(height / 2)
    return F.struct(x.alias("x"), y.alias("y"))


def image_page(width: Column, height: Column, sheet_w: float | None = None, sheet_h: float | None = None, margin: float = 0.0) -> Column:
    """Page size and box (l, b, r, t) of an image: three quarters of a point a pixel, or fitted within a sheet turned to its side."""
    if sheet_w is None or sheet_h is None:
        w, h = width * 0.75, height * 0.75
        zero = F.lit(0.0)
        return F.struct(w.alias("width"), h.alias("height"), zero.alias("l"), zero.alias("b"), w.alias("r"), h.alias("t"))
    wide = width > height
    page_w, page_h = F.when(wide, max(sheet_w, sheet_h)).otherwise(min(sheet_w, sheet_h)), F.when(wide, min(sheet_w, sheet_h)).otherwise(max(sheet_w, sheet_h))
    scale = F.least((page_w - 2 * margin) / width, (page_h - 2 * margin) / height)
    l, b = (page_w - width * scale) / 2, (page_h - height * scale) / 2
    return F.struct(page_w.alias("width"), page_h.alias("height"), l.alias("l"), b.alias("b"), (l + width * scale).alias("r"), (b + height * scale).alias("t"))


def padded_area(box: Column, padding: float, width: Column, height: Column, least: float = 3.0) -> Column:
    """An area in fractions of a page, grown by points on each side, to ``least`` points at least, and kept on the page."""

    def grown(low: Column, high: Column, length: Column) -> tuple[Column, Column]:
        pad = padding / length
        short = F.greatest(F.lit(0.0), least / length - (high - low + 2 * pad)) / 2
        return F.greatest(F.lit(0.0), low - pad - short), F.least(F.lit(1.0), high + pad + short)

    (l, r), (t, b) = grown(box["l"], box["r"], width), grown(box["t"], box["b"], height)
    return F.struct(l.alias("l"), t.alias("t"), r.alias("r"), b.alias("b"))


def signature(*options: Column) -> Column:
    """A text that changes with any of the options."""
    return F.to_json(F.struct(*options))


def compressed(streams: DataFrame, thumbnails: bool = True) -> DataFrame:
    """``streams`` (source, id, kind, entries, data) with data deflated anew where that is smaller, without metadata and, on demand, thumbnails.

    Streams of metadata go, external files of the others aren't looked up.
    """
    gone = ["Metadata", "Thumb"] if thumbnails else ["Metadata"]
    kept = streams.where(~F.col("kind").isin("metadata", *(["thumbnail"] if thumbnails else [])))
    return kept.withColumns({"entries": stripped(F.col("entries"), *gone, "F", "FFilter", "FDecodeParms"), "data": packed(F.col("data"))})


def smaller_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """``source, file``: a file after compression unless it was smaller before."""
    old = before.select("source", F.col("file").alias("old"))
    return after.join(old, "source").select("source", smaller(F.col("old"), F.col("file")).alias("file"))
