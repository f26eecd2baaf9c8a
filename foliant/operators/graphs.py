"""Object graphs: sharing, reachability, inheritance, outlines, dangling references."""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def settled(df: DataFrame) -> DataFrame:
    """Cuts the lineage of a loop through the folder that all executors share."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not (context.master.startswith("local[") or context.master == "local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-"))
    out = df.checkpoint()
    gc.collect()
    return out


def keepers(objects: DataFrame) -> DataFrame:
    """``id, keeper``: of equal objects (``kind, content``) the one with the least id. Contents meet as SHA-256 and length; they aren't moved themselves."""
    raw = F.col("content").cast("binary")
    marked = objects.select("id", "kind", F.sha2(raw, 256).alias("digest"), F.length(raw).alias("size"))
    least = marked.groupBy("kind", "digest", "size").agg(F.min("id").alias("keeper"))
    same = [marked[c].eqNullSafe(least[c]) for c in ("kind", "digest", "size")]
    return marked.join(least, same[0] & same[1] & same[2]).select("id", "keeper")


def share_identical(objects: DataFrame, refs: DataFrame, passes: int = 8) -> tuple[DataFrame, DataFrame]:
    """Objects and references after equal objects became one, again as long as that makes others equal, ``passes`` times at most.

    Objects are equal if their kind, content and the places they refer to are. Rewriting references is a join.
    """
    for _ in range(passes):
        edges = refs.groupBy("src").agg(F.array_sort(F.collect_list(F.struct("path", "dst"))).alias("refs"))
        full = objects.join(edges, objects.id == edges.src, "left").withColumn("key", F.to_json(F.struct("kind", "content", "refs")))
        least = full.groupBy("key").agg(F.min("id").alias("keeper"))
        moved = settled(full.join(least, "key").where("id <> keeper").select("id", "keeper"))
        if not moved.limit(1).count():
            break
        objects = settled(objects.join(moved, "id", "left_anti"))
        to = moved.select(F.col("id").alias("dst"), "keeper")
        refs = refs.join(moved.select(F.col("id").alias("src")), "src", "left_anti").join(to, "dst", "left")
        refs = settled(refs.select("src", F.coalesce("keeper", "dst").alias("dst"), "path"))
    return objects, refs


def reachable(refs: DataFrame, roots: DataFrame) -> DataFrame:
    """``id`` of every object that references lead to from ``roots``; cycles end by themselves. One join for each step outwards."""
    seen = settled(roots.select("id").distinct())
    front = seen
    while True:
        step = refs.join(front, refs.src == front.id).select(refs.dst.alias("id")).distinct().join(seen, "id", "left_anti")
        front = settled(step)
        if not front.limit(1).count():
            return seen
        seen = settled(seen.union(front))


def unreachable(objects: DataFrame, refs: DataFrame, roots: DataFrame) -> DataFrame:
    return objects.join(reachable(refs, roots), "id", "left_anti")


def dangling(objects: DataFrame, refs: DataFrame) -> DataFrame:
    """References to objects that aren't there; they read as null and have to stay so."""
    return refs.join(objects.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst")


def numbered(objects: DataFrame, start: int = 1, per_slice: int = 1 << 16) -> DataFrame:
    """``id, new``: whole-number ids counted from ``start`` in their order, each distinct id once.

    Running sums go over ranges of ids: first over the sizes of ranges, then within a range.
    """
    ids = objects.select("id").distinct().withColumn("slice", F.floor(F.col("id") / per_slice))
    over = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = ids.groupBy("slice").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(over), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("slice").orderBy("id"))
    return ids.join(slices, "slice").select("id", (F.col("before") + place + (start - 1)).alias("new"))


def renumber(objects: DataFrame, refs: DataFrame, start: int = 1) -> tuple[DataFrame, DataFrame]:
    """Objects and references with ids from ``start`` in the order of the old ones; what dangles gets one id after the last."""
    ids = numbered(objects, start)
    reserved = ids.agg(F.coalesce(F.max("new") + 1, F.lit(start)).alias("reserved")).first()[0]
    dst = ids.select(F.col("id").alias("dst"), F.col("new").alias("new_dst"))
    src = ids.select(F.col("id").alias("src"), F.col("new").alias("new_src"))
    moved = refs.join(src, "src").join(dst, "dst", "left")
    return objects.join(ids, "id").drop("id").withColumnRenamed("new", "id"), moved.select(F.col("new_src").alias("src"), F.coalesce("new_dst", F.lit(reserved)).alias("dst"))


def inherited(nodes: DataFrame, name: str, depth: int = 256) -> DataFrame:
    """``id, value, depth``: the nearest value of ``name`` from a node upwards along ``parent``; null where no ancestor has one.

    Each round doubles how far the open nodes look: a node takes over where the node it looks at stands. Beyond ``depth`` steps, as
    in a cycle, the value is null and the depth one more.
    """
    held, parent = F.col(name).isNotNull(), F.col("parent")
    state = nodes.select("id", F.col(name).alias("value"), F.when(~held, parent).alias("above"), F.when(held | parent.isNull(), 0).otherwise(1).alias("depth"))
    for _ in range(depth.bit_length() + 1):
        state = settled(state)
        if not state.where("above is not null").limit(1).count():
            break
        there = state.select(F.col("id").alias("above"), F.col("value").alias("v"), F.col("above").alias("next"), F.col("depth").alias("more"))
        looking = state.where("above is not null").join(there, "above", "left")
        moved = looking.select("id", F.col("v").alias("value"), F.col("next").alias("above"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
        state = state.where("above is null").union(moved)
    far = F.col("above").isNotNull() | (F.col("depth") > depth)
    return state.select("id", F.when(~far, F.col("value")).alias("value"), F.when(far, depth + 1).otherwise(F.col("depth")).alias("depth"))


OUTLINE = pa.list_(pa.struct([("idx", pa.int32()), ("level", pa.int32()), ("parent", pa.int32()), ("below", pa.int32())]))


def outline(headings: DataFrame) -> DataFrame:
    """``doc_id, idx, level, parent, below``: the nearest heading before with a lower level (null for none), and how many lie under it.

    One pass over a document's headings in order, with the open ones on a stack: what follows up to the next of its level or
    lower lies under a heading.
    """
    kind = headings.schema["doc_id"].dataType.simpleString()
    per = headings.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("level").cast("int").alias("level")))).alias("hs"))

    def fold(rows: list[dict]) -> list[dict]:
        out, open_ = [], []
        for at, row in enumerate(rows):
            lower = len(open_)
            while lower and open_[lower - 1][0] >= row["level"]:
                lower -= 1
                out[open_[lower][1]]["below"] = at - open_[lower][1] - 1
            del open_[lower:]
            out.append(row | {"parent": rows[open_[-1][1]]["idx"] if open_ else None, "below": 0})
            open_.append((row["level"], at))
        for _, at in open_:
            out[at]["below"] = len(rows) - at - 1
        return out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([fold(hs) for hs in batch.column("hs").to_pylist()], OUTLINE)], ["doc_id", "hs"])

    folded = per.mapInArrow(run, f"doc_id {kind}, hs array<struct<idx: int, level: int, parent: int, below: int>>")
    return folded.select("doc_id", F.inline("hs"))


def heading_parents(headings: DataFrame) -> DataFrame:
    """``doc_id, idx, level, parent``: the nearest heading before with a lower level; null for none."""
    return outline(headings).select("doc_id", "idx", "level", "parent")


def subtree_counts(headings: DataFrame) -> DataFrame:
    """``doc_id, idx, below``: how many headings lie under each, at any depth."""
    return outline(headings).select("doc_id", "idx", "below")
