"""Paragraphs and what is found in them: running heads, BM25, excerpts, central points, sources, parts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import text as T

PAGE = 10
#: Budget of excerpts and size of a part in characters; words traced and quoted; earlier turns; pages of a running head and its length.
BUDGET, PART, TRACED, QUOTED, TURNS, HEAD_PAGES, HEAD_LENGTH = 10_000, 5000, 0.3, 0.2, 3, 3, 120


def paragraphs(docs: DataFrame) -> DataFrame:
    """``doc_id, par_no, page_no, text``: the lines of each document, ten to a page, white space squeezed; null texts have none."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("par_no", "line"))
    return split.select("doc_id", "par_no", (F.floor(F.col("par_no") / PAGE) + 1).cast("int").alias("page_no"), T.squeeze(F.col("line")).alias("text"))


def without_heads(pars: DataFrame) -> DataFrame:
    """Paragraphs without those of one character or less and without running heads: short ones whose shape is on three pages or more.

    Only short paragraphs are counted by shape, an aggregate of their pages, and only they are looked up in the few heads found.
    """
    size = F.length("text")
    short = pars.where((size > 1) & (size < HEAD_LENGTH)).withColumn("shape", T.shape(F.col("text")))
    heads = short.select("doc_id", "shape", "page_no").distinct().groupBy("doc_id", "shape").agg(F.count("*").alias("pages")).where(F.col("pages") >= HEAD_PAGES)
    return pars.where(size >= HEAD_LENGTH).union(short.join(heads, ["doc_id", "shape"], "left_anti").select(*pars.columns))


def questions(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id, item_id, question``: one benchmark item asked of each document, in turn."""
    n = benchmark.select(F.max("item_id").alias("top"))
    asked = docs.select("doc_id").crossJoin(F.broadcast(n))  # one row
    asked = asked.select("doc_id", F.pmod("doc_id", F.col("top") + 1).alias("item_id"))
    return asked.join(benchmark.select("item_id", F.col("text").alias("question")), "item_id")


def bm25(pars: DataFrame, asked: DataFrame) -> DataFrame:
    """``doc_id, par_no, size, score``: how well each paragraph answers its document's question; only those that share a word.

    Each word counts once in a paragraph. Paragraphs meet their question once, by document; from then on only the
    words that both have are carried, and all counts are windows over the document.
    """
    wanted = T.word_set(F.col("question"))
    # A word as it may stand in a text: itself, unless it would lose a final s, and with one.
    forms = F.concat(F.filter("wanted", lambda w: ~w.endswith("s")), F.transform("wanted", lambda w: F.concat(w, F.lit("s"))))
    asked = asked.select("doc_id", wanted.alias("wanted")).select("doc_id", "wanted", forms.alias("forms"))
    met = pars.select("doc_id", "par_no", "text").join(asked, "doc_id")
    shared = F.when(F.col("text").rlike(T.UNSPACED), F.array_intersect(T.word_set(F.col("text")), "wanted")).otherwise(T.word_set_of(F.array_intersect(T.long_words(F.col("text")), "forms")))
    sized = met.select("doc_id", "par_no", F.length("text").alias("size"), shared.alias("words"))
    whole = Window.partitionBy("doc_id")
    sized = sized.withColumns({"n": F.count("*").over(whole), "average": F.avg("size").over(whole)})
    held = sized.withColumn("word", F.explode("words")).withColumn("held", F.count("*").over(Window.partitionBy("doc_id", "word")))
    idf = F.log(1 + (F.col("n") - F.col("held") + 0.5) / (F.col("held") + 0.5))
    scored = held.groupBy("doc_id", "par_no", "size", "average").agg(F.sum(idf).alias("idf"))
    return scored.select("doc_id", "par_no", "size", (F.col("idf") * 2.2 / (1 + 1.2 * (0.25 + 0.75 * F.col("size") / F.col("average")))).alias("score")).where("score > 0")


def excerpts(pars: DataFrame, asked: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``doc_id, par_no``: the paragraphs that answer best, as many as fit the budget, in document order.

    A document that fits is taken whole, and one that shares nothing with its question from its start. In order of rank
    a paragraph that doesn't fit is passed over, unless it is the first.
    """
    scores = bm25(pars, asked).select("doc_id", "par_no", F.round("score", 9).alias("score"))
    sized = pars.select("doc_id", "par_no", F.length("text").alias("size")).join(scores, ["doc_id", "par_no"], "left")
    per = sized.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.coalesce("score", F.lit(0.0))).alias("rank"), "par_no", "size"))).alias("order"), F.sum("size").alias("total"), F.max("score").alias("best")
    )
    start = F.expr("named_struct('kept', cast(array() as array<int>), 'length', 0)")

    def step(a, x):
        over = (a["length"] + x["size"] > budget) & (F.size(a["kept"]) > 0)
        done = a["length"] >= budget
        skip = over | done
        return F.struct(
            F.when(skip, a["kept"]).otherwise(F.concat(a["kept"], F.array(x["par_no"]))).alias("kept"), F.when(skip, a["length"]).otherwise(a["length"] + x["size"]).cast("int").alias("length")
        )

    order = F.when(F.col("best").isNull(), F.col("order")).otherwise(F.filter("order", lambda x: x["rank"] < 0))
    kept = F.when(F.col("total") <= budget, F.transform("order", lambda x: x["par_no"])).otherwise(F.aggregate(order, start, step)["kept"])
    return per.select("doc_id", F.explode(F.array_sort(kept)).alias("par_no"))


def central(points: DataFrame, pars: DataFrame, most: int) -> DataFrame:
    """``doc_id, point_no, text, score``: the points whose words the document holds most, ``most`` at most, in order.

    The score is the mean of ln(1 + paragraphs that hold the word) over a point's words. Texts are left
    behind until the points are chosen.
    """
    counts = pars.select("doc_id", F.explode(T.word_set(F.col("text"))).alias("word")).groupBy("doc_id", "word").agg(F.count("*").alias("n"))
    words = points.select("doc_id", "point_no", F.explode(T.word_set(F.col("text"))).alias("word"))
    means = words.join(counts, ["doc_id", "word"], "left").groupBy("doc_id", "point_no").agg(F.avg(F.log1p(F.coalesce("n", F.lit(0)))).alias("score"))
    scored = points.select("doc_id", "point_no").join(means, ["doc_id", "point_no"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    rank = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "point_no")
    top = scored.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= most).drop("rank")
    return top.join(points, ["doc_id", "point_no"]).select("doc_id", "point_no", "text", "score")


def shares(texts: DataFrame, pars: DataFrame) -> DataFrame:
    """``doc_id, par_no, page_no, share``: the part of a text's words that each paragraph of its document holds, where any."""
    said = texts.select("doc_id", T.word_set(F.col("said")).alias("words")).where(F.size("words") > 0)
    theirs = pars.select("doc_id", "par_no", "page_no", T.word_set(F.col("text")).alias("own"))
    joined = theirs.join(said, "doc_id")
    share = F.size(F.array_intersect("own", "words")) / F.size("words")
    return joined.select("doc_id", "par_no", "page_no", share.alias("share")).where("share > 0")


def traced(texts: DataFrame, pars: DataFrame, least: float = TRACED) -> DataFrame:
    """``doc_id, par_no, page_no``: the first of the paragraphs that hold most of a text's words; under ``least`` the first page and no paragraph."""
    best = shares(texts, pars).groupBy("doc_id").agg(F.max_by(F.struct("par_no", "page_no", "share"), F.struct("share", (-F.col("par_no")).alias("first"))).alias("b"))
    first = pars.groupBy("doc_id").agg(F.min("page_no").alias("first"))
    held = F.col("b.share") >= least
    return texts.select("doc_id").join(first, "doc_id").join(best, "doc_id", "left").select(
        "doc_id", F.when(held, F.col("b.par_no")).alias("par_no"), F.when(held, F.col("b.page_no")).otherwise(F.col("first")).alias("page_no")
    )


def sources(texts: DataFrame, pars: DataFrame, most: int = 3, least: float = QUOTED) -> DataFrame:
    """``doc_id, par_no, share``: the paragraphs that a text draws on most, in document order."""
    rank = Window.partitionBy("doc_id").orderBy(F.desc("share"), "par_no")
    ranked = shares(texts, pars).where(F.col("share") >= least).withColumn("rank", F.row_number().over(rank))
    return ranked.where(F.col("rank") <= most).select("doc_id", "par_no", "share")


PACKED = pa.schema([("part_no", pa.int32()), ("par_no", pa.int32()), ("piece", pa.string())])


def pack(lines: list[str], most: int = PART) -> list[tuple[int, int, str]]:
    """(part, paragraph, piece): pieces of up to ``most`` characters, cut after blanks; each joined piece takes two more."""
    out, part, used = [], 0, 0
    for no, line in enumerate(lines):
        at = 0
        while at < len(line):
            end = min(len(line), at + most)
            if end < len(line):
                blank = line.rfind(" ", 0, end + 1)
                end = blank + 1 if blank > 0 else end
                end = end if end > at else min(len(line), at + most)
            piece = line[at:end].strip()
            if used and used + len(piece) > most:
                part, used = part + 1, 0
            out.append((part, no, piece))
            used += len(piece) + 2
            at = end
    return out


def parts(docs: DataFrame, most: int = PART) -> DataFrame:
    """``doc_id, part_no, par_no, piece``: paragraphs packed into parts, document by document, without a shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    squeezed = docs.select("doc_id", F.transform(F.split("text", "\n"), T.squeeze).alias("lines"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [pack(lines or [], most) for lines in batch.column("lines").to_pylist()]
            at = [i for i, p in enumerate(packed) for _ in p]
            flat = [x for p in packed for x in p]
            columns = [pa.array([x[i] for x in flat], f.type) for i, f in enumerate(PACKED)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at, pa.int64())), *columns], ["doc_id", *PACKED.names])

    return squeezed.mapInArrow(run, f"doc_id {kind}, part_no int, par_no int, piece string")


def last_turns(conversations: DataFrame, most: int = TURNS) -> DataFrame:
    """The last turns of each conversation, earliest first by ``turn``."""
    rank = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return conversations.withColumn("back", F.row_number().over(rank)).where(F.col("back") <= most)


def found(pars: DataFrame, needle: str) -> DataFrame:
    """``doc_id, par_no, at``: places of ``needle`` in squeezed lower-case paragraphs, without overlap; an empty needle has none.

    Ligatures and wide forms are spelled out first.
    """
    needle = " ".join(needle.lower().split())
    if not needle:
        return pars.select("doc_id", "par_no", F.lit(0).alias("at")).limit(0)
    plain = T.squeeze(F.lower(F.when(F.col("text").rlike(r"[^\x00-˿]"), T.nfkc("text")).otherwise(F.col("text"))))
    pieces = F.split(plain, "(?:" + "".join(f"\\x{{{ord(c):x}}}" for c in needle) + ")", -1)
    hits = pars.select("doc_id", "par_no", pieces.alias("p")).where(F.size("p") > 1)
    ends = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.length(F.array_join(F.slice("p", F.lit(1), i), needle)))
    return hits.select("doc_id", "par_no", F.explode(ends).alias("at"))
