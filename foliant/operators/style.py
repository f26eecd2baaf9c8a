"""What style sheets say: font families, letter case, media for print, colours, clips, borders, pages of boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of names of fonts with fixed widths and with serifs.
FIXED_WIDTH = "mono|courier|consol|menlo|monaco|code|terminal|typewriter|lucida console|andale|fixed"
SERIFS = "serif|times|georgia|garamond|cambria|palatino|baskerville|antiqua|bookman|didot|bodoni|charter|merriweather|lora|minion|caslon|constantia|century|roman|crimson|playfair|mincho|song"
BOLD, NOWHERE = 600, 1e6


def family_class(stack: Column) -> Column:
    """The standard family nearest to the first font of a list."""
    first = F.lower(F.regexp_replace(F.trim(F.split(stack, ",")[0]), "^[\"']|[\"']$", ""))
    serif = (first == "serif") | (~F.contains(first, F.lit("sans")) & first.rlike(SERIFS))
    return F.when(first.rlike(FIXED_WIDTH), "courier").when(serif, "times").otherwise("helvetica")


def letter_case(text: Column, how: Column) -> Column:
    """Text in capitals, in small letters, or with capitals after the start, white space and punctuation, where nothing else changes."""
    letters = F.filter(F.split(text, ""), lambda c: c != "")
    starts = lambda i: (i == 0) | F.coalesce(F.try_element_at(letters, i), F.lit(" ")).rlike(r"[\s\p{Punct}\p{P}]")
    raised = F.array_join(F.transform(letters, lambda c, i: F.when(c.rlike(r"\p{L}") & starts(i), F.upper(c)).otherwise(c)), "")
    return F.when(how == "uppercase", F.upper(text)).when(how == "lowercase", F.lower(text)).when(how == "capitalize", raised).otherwise(text)


def print_media(media: Column) -> Column:
    """Media queries as they read in print: those for print hold always, those for the screen never, others stay."""
    form = r"(?is)^\s*(not\s+|only\s+)?(print|screen)\b(.*)$"

    def one(q: Column) -> Column:
        no, kind, rest = (F.regexp_extract(q, form, i) for i in (1, 2, 3))
        holds = (F.lower(kind) == "print") != F.lower(no).startswith("not")
        return F.when(~q.rlike(form), q).when(holds, F.concat(F.lit("all"), rest)).otherwise("not all")

    return F.when(F.trim(media) == "", media).otherwise(F.array_join(F.transform(F.transform(F.split(media, ","), lambda q: F.trim(q)), one), ", "))


def color(text: Column) -> Column:
    """Red, green and blue (0 to 255) and alpha of a colour in hex or rgb() form; null for another form."""
    plain = F.lower(F.trim(text))
    digits = F.substring(plain, 2, 8)
    long = F.when(F.length(digits).isin(3, 4), F.regexp_replace(digits, "(.)", "$1$1")).otherwise(digits)
    byte = lambda i: F.conv(F.substring(long, 2 * i + 1, 2), 16, 10).cast("double")
    alpha = F.when(F.length(long) == 8, byte(3) / 255).otherwise(F.lit(1.0))
    numbers = F.transform(F.regexp_extract_all(plain, F.lit(r"[0-9]*\.?[0-9]+"), F.lit(0)), lambda n: n.cast("double"))
    called = F.when(plain.rlike(r"^rgba?\(") & (F.size(numbers) >= 3), F.concat(F.slice(numbers, 1, 3), F.array(F.coalesce(F.try_element_at(numbers, F.lit(4)), F.lit(1.0)))))
    return F.when(plain.rlike("^#([0-9a-f]{3,4}|[0-9a-f]{6}|[0-9a-f]{8})$"), F.array(byte(0), byte(1), byte(2), alpha)).otherwise(called)


def size_text(size: Column) -> Column:
    """A number of bytes in KB, at least one unless there are none, or in MB with one decimal."""
    kilo = F.greatest(F.lit(1), F.floor(size / 1024 + 0.5))
    mega = F.format_string("%.1f", F.floor(size / 1024 / 1024 * 10 + 0.5) / 10)
    return F.when(size == 0, "0 KB").when(size < 1024 * 1024, F.concat(kilo.cast("string"), F.lit(" KB"))).otherwise(F.concat(mega, F.lit(" MB")))


def page_of(left: Column, gap: float, stride: float) -> Column:
    """The page of a box in a row of columns, from 0."""
    return F.greatest(F.lit(0), F.floor((left + gap / 2) / stride)).cast("int")


def clips(boxes: DataFrame, gap: float, stride: float, width: float, height: float, margin: float) -> DataFrame:
    """``boxes`` with ``page`` and ``clip``: where a box that hides its overflow lets its content show.

    Inside its borders along hidden axes, within what its parent on the same page lets show (``outer_page, outer``), and within its column.
    """
    page = page_of(F.col("l"), gap, stride)
    inner = {"l": F.col("l") + F.col("border"), "t": F.col("t") + F.col("border"), "r": F.col("r") - F.col("border"), "b": F.col("b") - F.col("border")}
    hidden = {"l": F.col("hides_x"), "r": F.col("hides_x"), "t": F.col("hides_y"), "b": F.col("hides_y")}
    same = F.coalesce(F.col("outer_page") == page, F.lit(False))
    column = page * F.lit(stride)
    edge = {"l": column - gap / 2, "t": F.lit(-margin), "r": column + width + gap / 2, "b": F.lit(height + margin)}
    out = []
    for c in "ltrb":
        far, best = (F.lit(-NOWHERE), F.greatest) if c in "lt" else (F.lit(NOWHERE), F.least)
        out.append(best(F.when(hidden[c], inner[c]).otherwise(far), F.when(same, F.col("outer")[c]).otherwise(far), edge[c]).alias(c))
    return boxes.withColumns({"page": page, "clip": F.struct(*out)})


def borders(boxes: DataFrame) -> DataFrame:
    """``key, side, width, color``: one outline where all four sides are alike, else a line for each side that shows.

    ``sides`` is an array of four structs of width and colour, from the top around.
    """
    alike = F.forall("sides", lambda s: (s["width"] == F.col("sides")[0]["width"]) & (s["color"] == F.col("sides")[0]["color"]))
    every = F.transform(F.arrays_zip(F.array(*map(F.lit, ("top", "right", "bottom", "left"))).alias("side"), "sides"), lambda z: F.struct(z["side"].alias("side"), z["sides"]["width"].alias("width"), z["sides"]["color"].alias("color")))
    whole = F.array(F.struct(F.lit("outline").alias("side"), F.col("sides")[0]["width"].alias("width"), F.col("sides")[0]["color"].alias("color")))
    return boxes.select("key", F.explode(F.when(alike, whole).otherwise(every)).alias("s")).select("key", "s.*").where("width > 0")


def used_fonts(runs: DataFrame) -> DataFrame:
    """``family, bold``: each font that a page needs, once."""
    return runs.select(family_class(F.col("stack")).alias("family"), (F.col("weight") >= BOLD).alias("bold")).distinct()


def numbered_images(uses: DataFrame) -> DataFrame:
    """``uses`` (page, pos, key) with ``image``: one number for each key of a page, by its first use, from 0."""
    first = uses.groupBy("page", "key").agg(F.min("pos").alias("first"))
    ids = first.select("page", "key", (F.row_number().over(Window.partitionBy("page").orderBy("first")) - 1).alias("image"))
    return uses.join(ids, ["page", "key"]).select(*uses.columns, "image")


def generated_text(content: Column, attributes: Column) -> Column:
    """The text that a style's content makes: quoted strings and values of attributes, joined; null for none and for pictures alone."""
    parts = F.regexp_extract_all(content, F.lit(r"""(\"[^\"]*\"|'[^']*'|attr\([^)]*\))"""), F.lit(1))
    one = lambda p: F.when(p.startswith("attr("), F.coalesce(F.try_element_at(attributes, F.regexp_extract(p, r"attr\(\s*([^)\s]*)\s*\)", 1)), F.lit(""))).otherwise(F.substring(p, F.lit(2), F.length(p) - 2))
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, one), ""))


def first_line(item: Column) -> Column:
    """The first text of a list item's HTML that isn't blank and comes before a list inside it; null without any."""
    own = F.regexp_extract(item, r"(?is)^(.*?)(?:<(?:ul|ol)\b.*)?$", 1)
    texts = F.filter(F.transform(F.split(own, "<[^>]*>"), lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))), lambda t: t != "")
    return F.try_element_at(texts, F.lit(1))
