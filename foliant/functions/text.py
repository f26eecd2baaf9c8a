"""Text as columns: word sets, shapes, markers, escapes, names and sizes."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

#: Words that don't tell paragraphs apart.
STOP_WORDS = (
    "the and for are but not you all any can had her was one our out has have this that with from they will would there their what which when where who whom been were into than then them these those "
    "such some more most other only very also its your about after before over under between through during while because each both same just should could does did doing being here how why may might "
    "must shall upon onto off"
).split()
UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsThai}]"
#: White space as browsers trim it, beyond ASCII.
BLANK = "[\\s\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def squeeze(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"(?!{BLANK})[\\s\\S]")


def long_words(text: Column) -> Column:
    """Distinct words of three letters and more that aren't stop words, in small letters."""
    return F.array_except(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]{3,}"), F.lit(0)), F.lit(STOP_WORDS))


def word_set_of(words: Column) -> Column:
    """``words`` with one final s off, once each; one text function over all of them."""
    bare = F.split(F.replace(F.concat(F.array_join(words, " "), F.lit(" ")), F.lit("s "), F.lit(" ")), " ")
    return F.array_except(bare, F.array(F.lit("")))


def word_set(text: Column) -> Column:
    """Distinct words to compare by: over two letters, no stop words, one final s off; pairs of characters where words have no spaces.

    Sets and text functions over a whole paragraph at once do it, and only text without spaces goes word by word.
    """
    return F.when(text.rlike(UNSPACED), unspaced_word_set(text)).otherwise(word_set_of(long_words(text)))


def unspaced_word_set(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    stop = F.lit(STOP_WORDS)

    def each(w: Column) -> Column:
        pairs = F.when(F.length(w) > 1, F.transform(F.sequence(F.lit(1), F.length(w) - 1), lambda i: F.substring(w, i, F.lit(2))))
        plain = F.when((F.length(w) > 2) & ~F.array_contains(stop, w), F.array(F.regexp_replace(w, "s$", "")))
        return F.coalesce(F.when(w.rlike(UNSPACED), pairs).otherwise(plain), F.expr("cast(array() as array<string>)"))

    return F.array_distinct(F.flatten(F.transform(found, each)))


def shape(text: Column) -> Column:
    """Lower case, each run of digits as one sign: what running heads have in common."""
    return F.regexp_replace(F.lower(text), "[0-9]+", "#")


POINT = r"^([-*•]|[0-9]+[.)])\s+"


def listed_points(text: Column) -> Column:
    """The points of a list in Markdown: marked lines if any, else lines that don't end in a colon; without markers and bold signs."""
    lines = F.filter(F.transform(F.split(text, "\n"), squeeze_ends), lambda x: x != "")
    listed = F.filter(lines, lambda x: x.rlike(POINT))
    chosen = F.when(F.size(listed) > 0, listed).otherwise(F.filter(lines, lambda x: ~x.endswith(":")))
    bare = F.transform(chosen, lambda x: squeeze_ends(F.replace(F.regexp_replace(x, POINT, ""), F.lit("**"), F.lit(""))))
    return F.filter(bare, lambda x: x != "")


def squeeze_ends(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


def clip(text: Column, most: int = 2000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("…"))).otherwise(text)


def html_escape(text: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def xml_escape(text: Column) -> Column:
    """Like ``html_escape``, without control characters that XML doesn't allow."""
    return html_escape(F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", ""))


def page_list(pages: Column) -> Column:
    """``page 3`` or ``pages 1, 2 and 5``; empty for no page."""
    names = F.transform(pages, lambda p: p.cast("string"))
    several = F.concat(F.lit("pages "), F.array_join(F.slice(names, F.lit(1), F.size(names) - 1), ", "), F.lit(" and "), F.try_element_at(names, F.lit(-1)))
    return F.when(F.size(names) == 0, "").when(F.size(names) == 1, F.concat(F.lit("page "), F.try_element_at(names, F.lit(1)))).otherwise(several)


def standard_family(name: Column) -> tuple[Column, Column]:
    """Family of the standard fonts and boldness that a font's name tells, without its subset tag."""
    plain = F.lower(F.regexp_replace(name, r"^[A-Z]{6}\+", ""))
    family = F.when(plain.rlike("cour|mono|consol"), "courier").when(plain.rlike("times|serif|roman|georgia|garamond|minion|cambria") & ~plain.rlike("sans"), "times").otherwise("helvetica")
    return family, plain.rlike("bold|black|heavy|semibold")


def version_key(version: Column) -> Column:
    """(major, minor) as a struct that sorts by number; missing or odd parts count as zero."""
    part = lambda i: F.coalesce(F.split_part(version, F.lit("."), F.lit(i)).try_cast("int") if hasattr(Column, "try_cast") else F.split_part(version, F.lit("."), F.lit(i)).cast("int"), F.lit(0))
    return F.struct(part(1).alias("major"), part(2).alias("minor"))


PDF_DATE = r"^(?:D:)?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?(\d{2})?'?)?"


def xmp_date(text: Column) -> Column:
    """A PDF date string of any precision as an XMP date; null if a part is out of its range."""
    g = lambda i: F.regexp_extract(text, PDF_DATE, i)
    month, day, hour, minute, second = (g(i) for i in range(2, 7))
    zone = F.when(g(7) == "Z", "Z").when(g(8) != "", F.concat(g(8), g(9), F.lit(":"), F.when(g(10) == "", "00").otherwise(g(10)))).otherwise("Z")
    number = lambda c: F.when(c == "", None).otherwise(c).cast("int")
    fits = lambda c, low, high: (c == "") | number(c).between(low, high)
    ok = (g(1) != "") & fits(month, 1, 12) & fits(day, 1, 31) & fits(hour, 0, 23) & fits(minute, 0, 59) & fits(second, 0, 59)
    date = F.concat_ws("-", g(1), F.when(month != "", month), F.when(day != "", day))
    clock = F.concat(F.lit("T"), hour, F.lit(":"), F.when(minute == "", "00").otherwise(minute), F.when(second != "", F.concat(F.lit(":"), second)).otherwise(""), zone)
    return F.when(ok, F.concat(date, F.when(hour != "", clock).otherwise("")))


def utf16_hex(text: Column) -> Column:
    """A PDF text string: ASCII as it is, anything else as UTF-16BE in hex with its mark."""
    return F.when(text.rlike(r"^[\x00-\x7f]*$"), text).otherwise(F.concat(F.lit("<FEFF"), F.hex(F.encode(text, "UTF-16BE")), F.lit(">")))


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility form, where ligatures and wide forms are spelled out; Spark has no such function."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(StringType())
def nfkd(text: pd.Series) -> pd.Series:
    """Compatibility form with marks apart from their letters."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))


def osa(a: str, b: str) -> int:
    """Edit distance in which swapping two neighbours is one edit and no stretch is edited twice."""
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            best = min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, older[j - 2] + 1)
            row.append(best)
        older, old = old, row
    return old[-1]


@F.pandas_udf(IntegerType())
def osa_distance(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([osa(x, y) for x, y in zip(a, b, strict=True)])


ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def marker(kind: str, n: int) -> str | None:
    """The text of a list item's marker; null for pictures and for no marker."""
    signs = {"disc": "•", "circle": "◦", "square": "▪"}
    if kind in signs:
        return signs[kind]
    if kind == "none":
        return None
    name = kind.removeprefix("lower-").removeprefix("upper-")
    if kind == "decimal-leading-zero":
        return f"{'-' if n < 0 else ''}{abs(n):02d}."
    if name == "roman" and 0 < n < 4000:
        out = ""
        for value, sign in ROMAN:
            count, n = divmod(n, value)
            out += sign * count
    elif name in ("alpha", "latin", "greek") and n > 0:
        letters = "αβγδεζηθικλμνξοπρστυφχψω" if name == "greek" else "abcdefghijklmnopqrstuvwxyz"
        out = ""
        while n > 0:
            n, at = divmod(n - 1, len(letters))
            out = letters[at] + out
    else:
        return f"{n}."
    return (out.upper() if kind.startswith("upper-") else out) + "."


@F.pandas_udf(StringType())
def marker_text(kind: pd.Series, ordinal: pd.Series) -> pd.Series:
    return pd.Series([marker(k, int(n)) for k, n in zip(kind, ordinal, strict=True)])


def canonical(entries: Column) -> Column:
    """A map of texts as one text that tells equal maps: keys in order, each part with its length."""
    part = lambda tag, t: F.concat(F.lit(tag), F.octet_length(t).cast("string"), F.lit(":"), t)
    pairs = F.array_sort(F.map_entries(entries))
    return F.concat(F.lit("D"), F.size(pairs).cast("string"), F.lit(":"), F.array_join(F.transform(pairs, lambda e: F.concat(part("K", e["key"]), part("S", e["value"]))), ""))


def names_in(dictionary: Column) -> Column:
    """The names that a dictionary's text holds, once each, in order."""
    return F.array_distinct(F.regexp_extract_all(dictionary, F.lit(r"/([^\s/<>\[\]()]+)"), F.lit(1)))
