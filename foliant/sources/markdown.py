"""Markdown in and out: titles, summaries, conversations, pages; and files packed together."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAGE_BREAK = "\n\n---\n\n"


def title(markdown: Column) -> Column:
    """The first heading without signs of emphasis, code and links; empty without a heading."""
    plain = F.regexp_replace(markdown, "^\\ufeff", "")
    return F.trim(F.regexp_replace(F.regexp_extract(plain, r"(?m)^#{1,6}[ \t]+(.+?)[ \t#]*$", 1), r"[*_`~\[\]]", ""))


def in_order(rows: Column, text) -> Column:
    """Texts of structs, put in order by their first field, as an array."""
    return F.transform(F.array_sort(rows), text)


def summary(points: DataFrame) -> DataFrame:
    """``doc_id, markdown`` from points (doc_id, title, overview, point_no, text, page_no): a heading, the overview, a line for each point."""
    line = lambda p: F.concat(F.lit("- "), p["text"], F.lit(" (page "), p["page_no"].cast("string"), F.lit(")"))
    per = points.groupBy("doc_id", "title", "overview").agg(F.collect_list(F.struct("point_no", "text", "page_no")).alias("ps"))
    head = F.concat(F.lit("# Summary of "), F.col("title"))
    return per.select("doc_id", F.concat_ws("\n\n", head, F.nullif("overview", F.lit("")), F.array_join(in_order(F.col("ps"), line), "\n")).alias("markdown"))


def conversation(turns: DataFrame) -> DataFrame:
    """``conv_id, markdown``: questions as headings, what answers them below, in order of turns."""
    text = lambda t: F.when(t["role"] == "user", F.concat(F.lit("## "), t["text"])).otherwise(t["text"])
    per = turns.groupBy("conv_id").agg(F.collect_list(F.struct("turn", "role", "text")).alias("ts"))
    return per.select("conv_id", F.array_join(in_order(F.col("ts"), text), "\n\n").alias("markdown"))


def document(pages: DataFrame) -> DataFrame:
    """``doc_id, markdown`` from pages (doc_id, page_no, text): trimmed, without empty ones, rules between them; bold runs that touch become one."""
    per = pages.groupBy("doc_id").agg(F.collect_list(F.struct("page_no", F.trim("text").alias("text"))).alias("ps"))
    kept = F.filter(in_order(F.col("ps"), lambda p: p["text"]), lambda t: t != "")
    return per.select("doc_id", F.regexp_replace(F.array_join(kept, PAGE_BREAK), r"\*\*(\s*)\*\*", "$1").alias("markdown"))


def part_names(parts: DataFrame, stem: str, ending: str) -> DataFrame:
    """``parts`` with ``name``: numbered with as many digits as the number of parts of a job needs; a single part has no number."""
    n = parts.groupBy("job").agg(F.count("*").alias("_n"))
    number = F.lpad((F.col("part") + 1).cast("string"), F.length(F.col("_n").cast("string")), F.lit("0"))
    name = F.when(F.col("_n") == 1, F.lit(f"{stem}.{ending}")).otherwise(F.concat(F.lit(f"{stem}-"), number, F.lit(f".{ending}")))
    return parts.join(n, "job").withColumn("name", name).drop("_n")


def zipped(parts: DataFrame) -> DataFrame:
    """``job, file, format``: a job's only file as it is, several stored in a zip by ``name``."""

    def of(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        rows = group.sort_values("name").to_dict("records")
        if len(rows) == 1:
            return pd.DataFrame({"job": [key[0]], "file": [bytes(rows[0]["file"])], "format": [rows[0]["name"].rsplit(".", 1)[-1]]})
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for r in rows:
                archive.writestr(zipfile.ZipInfo(r["name"]), bytes(r["file"]))
        return pd.DataFrame({"job": [key[0]], "file": [out.getvalue()], "format": ["zip"]})

    return parts.groupBy("job").applyInPandas(of, f"job {parts.schema['job'].dataType.simpleString()}, file binary, format string")
