"""What HTML files hold: charset, title, headings, links, and what is cleaned out of them. Patterns over the text, on the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING = r"(?is)<h[1-6][^>]*>.*?</h[1-6]>"
LINK = r'(?is)<a\s[^>]*?href="([^"]*)"'


def decoded(raw: Column) -> Column:
    """Text of a file's bytes: its byte order mark tells the charset, else a ``meta charset`` in the first 2048 bytes, else UTF-8."""
    head = F.decode(F.substring(raw, 1, 2048), "ISO-8859-1")
    named = F.lower(F.regexp_extract(head, r"""(?i)<meta[^>]+charset=["']?\s*([a-z0-9_-]+)""", 1))
    mark = F.hex(F.substring(raw, 1, 3))
    return (
        F.when(mark.startswith("EFBBBF"), F.decode(F.substring(raw, 4, 1 << 30), "UTF-8"))
        .when(mark.startswith("FEFF"), F.decode(F.substring(raw, 3, 1 << 30), "UTF-16BE"))
        .when(mark.startswith("FFFE"), F.decode(F.substring(raw, 3, 1 << 30), "UTF-16LE"))
        .when(named.isin("iso-8859-1", "latin1", "windows-1252", "us-ascii"), F.decode(raw, "ISO-8859-1"))
        .otherwise(F.decode(raw, "UTF-8"))
    )


def title(html: Column) -> Column:
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def bare(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", ""), r"\s+", " "))


def headings(pages: DataFrame, key: str) -> DataFrame:
    """``key, n, level, title``: headings with any text, in order from 1."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(HEADING), F.lit(0))).alias("n", "h"))
    out = found.select(key, (F.col("n") + 1).alias("n"), F.regexp_extract("h", r"(?i)^<h([1-6])", 1).cast("int").alias("level"), bare(F.col("h")).alias("title"))
    return out.where("title <> ''")


def anchors(pages: DataFrame, key: str) -> DataFrame:
    """``key, n, target, kind``: every link in order from 1; ``dropped`` are those to neither a place in the page nor an address."""
    found = pages.select(key, F.posexplode(F.regexp_extract_all("html", F.lit(LINK), F.lit(1))).alias("n", "target"))
    kind = F.when(F.col("target").startswith("#"), "place").when(F.col("target").rlike(r"(?i)^(https?:|mailto:|tel:|ftp:)"), "address").otherwise("dropped")
    return found.select(key, (F.col("n") + 1).alias("n"), "target", kind.alias("kind"))


def links(pages: DataFrame, key: str) -> DataFrame:
    """Links to places in the page and to web, mail, phone and file addresses."""
    return anchors(pages, key).where("kind <> 'dropped'")


def sanitized(html: Column) -> Column:
    """HTML without scripts, frames, embedded objects and what points the page elsewhere."""
    without = F.regexp_replace(html, r"(?is)<script\b.*?</script\s*>", "")
    return F.regexp_replace(without, r"(?is)<(iframe|object|embed|base|link|meta\b[^>]*http-equiv)\b[^>]*>", "")


def skipped_images(html: Column) -> Column:
    """Number of images that aren't held in the page itself and so aren't loaded."""
    return F.regexp_count(html, F.lit(r"""(?i)<img\b[^>]*\bsrc(set)?=["'](?!data:)"""))
