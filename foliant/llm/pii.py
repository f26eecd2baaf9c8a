"""Personal data: regular expressions propose, checksums confirm, nearby words adjust the score. Column functions only."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The possessive parts and look-behinds only cut off attempts that can't succeed; matches are those of the plain forms.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: The length of an IBAN by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA",
    23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
    28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = r"(?<![A-Za-z0-9])(?:" + "|".join(f"(?:{'|'.join(own.split())})[0-9]{{2}}(?:\\x20?[A-Z0-9]){{{n - 4}}}" for n, own in IBAN_LENGTHS.items()) + r")(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"


@dataclass(frozen=True)
class Kind:
    """``least``: characters without which no match is possible. ``start``: score of a confirmed match, before its context."""

    name: str
    pattern: str
    least: str
    base: bool
    start: float
    near: str


#: In the order in which kinds with the same start are listed.
KINDS = (
    Kind("email", EMAIL, "@", True, 0.8, "mail|contact|write|address"),
    Kind("ip", IP, ".", True, 0.6, r"\bip\b|host|server|address|login"),
    Kind("card", CARD, "", True, 0.8, "card|visa|credit|debit|pay"),
    Kind("phone", PHONE, "+", True, 0.7, "phone|call|tel|mobile|fax|contact"),
    Kind("iban", IBAN, "", False, 0.8, "iban|bank|account|transfer"),
    Kind("ssn", SSN, "-", False, 0.3, r"\bssn\b|social security|tax"),
)
#: Spans that the method adds need so much; the base kinds stay whatever their score. Context counts at so many code points to each side.
THRESHOLD, NEAR, AROUND = 0.5, 0.2, 40


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes Luhn: from the right every second digit counts double, less 9 if over 9."""
    back = F.split(F.reverse(number), "")
    each = F.transform(F.filter(back, lambda c: c != ""), lambda c, i: F.when(i % 2 == 1, c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """Whether an IBAN's digits leave 1 by 97, with its first four characters last and letters as 10 to 35."""
    code = F.regexp_replace(iban, r"\x20", "")
    moved = F.concat(F.substring(code, 5, 40), F.substring(code, 1, 4))
    step = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), step) == 1


def confirmed(kind: str, match: Column) -> Column:
    n = F.length(digits(match))
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
        return F.forall(F.split(match, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.substring(part(p), 1, 3).cast("int") <= 255))
    if kind == "card":
        return F.when(n.between(14, 19), luhn(digits(match))).otherwise(False)
    if kind == "phone":
        return n.between(10, 15)
    if kind == "iban":
        return mod97(match)
    if kind == "ssn":
        return ~F.substring(match, 1, 3).isin("000", "666") & (F.substring(match, 1, 1) != "9") & (F.substring(match, 5, 2) != "00") & (F.substring(match, 8, 4) != "0000")
    return F.lit(True)


def located(kind: Kind, text: Column) -> Column:
    """Array of ``start, end, match``: the stretches between matches tell where each one lies, in code points."""
    found = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    between = F.transform(F.split(text, kind.pattern, -1), F.length)
    empty = F.expr("cast(array() as array<struct<start:int,end:int,match:string>>)")

    def step(a: Column, x: Column) -> Column:
        end = F.when(F.size(a) > 0, F.element_at(a, -1)["end"]).otherwise(0)
        start = end + x["gap"]
        one = F.struct(start.alias("start"), (start + F.length(x["match"])).alias("end"), x["match"].alias("match"))
        return F.concat(a, F.array(one))

    steps = F.zip_with(found, F.slice(between, 1, F.size(found)), lambda m, g: F.struct(g.alias("gap"), m.alias("match")))
    hit = F.size(found) > 0
    out = F.when(hit, F.aggregate(steps, empty, step)).otherwise(empty)
    return F.when(F.contains(text, F.lit(kind.least)), out).otherwise(empty) if kind.least else out


def spans(df: DataFrame, text: Column, into: str, kinds=KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """``df`` with an array of ``start, rank, end, kind, base, score``, by start and then kind."""
    for k in kinds:
        df = df.withColumn(f"{into}_{k.name}", located(k, text))

    def scored(rank: int, k: Kind) -> Column:
        kept = F.filter(F.col(f"{into}_{k.name}"), lambda m: confirmed(k.name, m["match"]))

        def score(m: Column) -> Column:
            first = F.greatest(m["start"] - AROUND, F.lit(0))
            window = F.lower(F.concat_ws(" ", F.substring(text, first + 1, m["start"] - first), F.substring(text, m["end"] + 1, F.lit(AROUND))))
            s = F.lit(k.start) + F.when(window.rlike(k.near), NEAR).otherwise(0.0)
            return F.struct(m["start"].alias("start"), F.lit(rank).alias("rank"), m["end"].alias("end"), F.lit(k.name).alias("kind"), F.lit(k.base).alias("base"), F.round(s, 2).alias("score"))

        return F.filter(F.transform(kept, score), lambda s: s["base"] | (s["score"] >= threshold))

    every = F.array_sort(reduce(F.concat, [scored(i, k) for i, k in enumerate(kinds)]) if len(kinds) > 1 else scored(0, kinds[0]))
    return df.withColumn(into, every).drop(*[f"{into}_{k.name}" for k in kinds])


def listed(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def detect(docs: DataFrame, kinds=KINDS, threshold: float = THRESHOLD) -> DataFrame:
    """``row, text, found`` for each row of ``docs``: all its columns in a struct, its text (null: empty) and the array of its spans.

    Base kinds keep every confirmed match; kinds of the method (IBAN by its country's length and mod-97, social security numbers by
    their ranges) need a score of ``threshold``, which context words raise. A null or empty text has no
    spans. Rows are independent: repeated rows get equal spans, no row moves between tasks, an empty table gives an empty result, and
    whatever other columns are called, they stay within the struct. Offsets are code points, ends exclusive; a text of any length is
    read whole. Spans of different kinds may overlap; those with the same start come in the order of KINDS.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return spans(packed, F.col("text"), "found", kinds, threshold)


def redact(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; overlapping spans become one, named by the first.

    A null text stays null, an empty one empty, and a text without spans as it is. ``n_chars``, where there is such a column, becomes the
    new length where the text changed. Repeated rows change alike; other columns pass through, whatever their names; an empty table stays empty.
    """
    merged = F.expr(
        "aggregate(found, cast(array() as array<struct<start:int,end:int,kind:string>>), (a, s) -> "
        "case when size(a) > 0 and s.start < element_at(a, -1).end then "
        "concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, s.end), 'kind', element_at(a, -1).kind))) "
        "else concat(a, array(named_struct('start', s.start, 'end', s.end, 'kind', s.kind))) end)"
    )
    cut = F.expr(
        "aggregate(merged, named_struct('out', cast(array() as array<string>), 'at', 0), (a, s) -> named_struct('out', "
        "concat(a.out, array(substring(text, a.at + 1, s.start - a.at), concat('[', upper(s.kind), ']'))), 'at', s.end), "
        "a -> array_join(concat(a.out, array(substring(text, a.at + 1))), ''))"
    )
    out = detect(docs, threshold=threshold).withColumn("merged", merged)
    out = out.withColumn("changed", F.when(F.size("merged") > 0, cut))
    new = {"text": F.coalesce("changed", F.col("row.text"))}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("changed").isNotNull(), F.length("changed").cast(kind)).otherwise(F.col("row.n_chars"))
    return out.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` and ``n_added, scores``, one row for each row of ``docs``."""
    out = detect(docs.select("doc_id", "text"))
    found = F.col("found")
    base = F.filter(found, lambda s: s["base"])
    count = lambda kind: F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "row.doc_id", *[count(k.name).alias(f"n_{k.name}") for k in KINDS if k.base], F.sha2(listed(base), 256).alias("base_sha256"), listed(found).alias("spans"),
        F.size(F.filter(found, lambda s: ~s["base"])).cast("long").alias("n_added"), F.array_join(F.transform(found, lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
