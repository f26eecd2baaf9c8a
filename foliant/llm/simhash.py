"""SimHash near-duplicates: an inverted index of positional bytes with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import batches, durable, rows_of, texts
from foliant.llm.components import components

SHINGLE, SEED, BITS = 3, 42, 3
#: Of 8 positional bytes, 3 differing bits leave at least 5 equal.
LEAST_EQUAL = 8 - BITS
#: Posting lists up to so many distinct fingerprints are paired within a task; longer ones go by variants, over many tasks.
LIST_LIMIT = 1024
#: Quadruples of byte positions whose exclusive or is zero: 14 of them, and any three positions lie outside exactly one.
#: So two fingerprints with three unequal bytes at most share all four bytes of one quadruple.
QUADS = tuple(q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0)


def shingle_hashes(text: bytes) -> list[int]:
    words = text.lower().split()  # bytes: A-Z only, and the white space of the contract
    n = len(words)
    if n < SHINGLE:
        return [xxhash.xxh64_intdigest(b" ".join(words), SEED)] if n else []
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    return [digest(joined[a:b], SEED) for a, b in zip(starts[: n - SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]


def fingerprint(text: bytes) -> int:
    """64 bits: each is 1 if set in over half of the shingles' hashes; zero without words."""
    hashes = shingle_hashes(text)
    if not hashes:
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], np.uint64)
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (a signed long) for each row of ``docs``."""
    kind = docs.schema["doc_id"].dataType

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            fps = np.array([fingerprint(t) for t in texts(batch)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fps)], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def postings(fps: DataFrame) -> DataFrame:
    """``key, fp``: fourteen rows for a distinct fingerprint, one for each quadruple of its positional bytes."""

    def key(i: int, quad: tuple[int, ...]) -> Column:
        out = F.lit(i).cast("long")
        for position in quad:
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned("fp", 8 * position).bitwiseAND(F.lit(255)))
        return out

    return fps.select(F.explode(F.array(*[key(i, q) for i, q in enumerate(QUADS)])).alias("key"), "fp")


class Forest:
    """Union-find over row numbers."""

    def __init__(self, n: int) -> None:
        self.up = np.arange(n)

    def roots(self, x: np.ndarray) -> np.ndarray:
        r = self.up[x]
        while True:
            nxt = self.up[r]
            if np.array_equal(nxt, r):
                return r
            self.up[x] = nxt
            r = nxt

    def join(self, i: int, j: int) -> bool:
        a, b = i, j
        while self.up[a] != a:
            a = self.up[a]
        while self.up[b] != b:
            b = self.up[b]
        self.up[max(a, b)] = min(a, b)
        return a != b


def linked(keys: np.ndarray, fps: np.ndarray) -> tuple[list[int], list[int]]:
    """A spanning forest of the links within each posting list; keys are sorted.

    At each distance along the lists, the equal bytes of the pairs are tallied, the pairs under the
    guaranteed count go, and the rest are verified by their differing bits. Only links that join two
    parts are kept, so that a list gives fewer links than it has rows.
    """
    forest, at, step, out = Forest(len(keys)), np.arange(len(keys)), 1, ([], [])
    bits = fps.view(np.uint64)
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            return out
        x = bits[at] ^ bits[at + step]
        near = (x.view(np.uint8).reshape(-1, 8) == 0).sum(1) >= LEAST_EQUAL
        near[near] = np.bitwise_count(x[near]) <= BITS
        a = at[near]
        apart = a[forest.roots(a) != forest.roots(a + step)] if len(a) else a
        for i in apart.tolist():
            if forest.join(i, i + step):
                out[0].append(int(fps[i]))
                out[1].append(int(fps[i + step]))
        step += 1


EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def list_links(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of whole posting lists from batches sorted by key; a list that the batch may not end is carried on."""
    keys, fps = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in parts:
        keys = np.concatenate([keys, batch.column("key").to_numpy(zero_copy_only=False)])
        fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False)])
        if not len(keys):
            continue
        cut = int(np.searchsorted(keys, keys[-1]))
        a, b = linked(keys[:cut], fps[:cut])
        keys, fps = keys[cut:], fps[cut:]
        yield rows_of({"a": a, "b": b}, EDGES)
    a, b = linked(keys, fps)
    yield rows_of({"a": a, "b": b}, EDGES)


def variant_links(long: DataFrame) -> DataFrame:
    """Links of the long lists, exact, in rows that grow with the list and not with its square.

    Within a list four bytes are equal, so the differing bits are among 32. Each fingerprint is dealt to its
    variants by up to two flipped bits; two fingerprints at three bits share a variant that is one flip from
    one of them and two from the other. A variant has 529 rows at most: those within one flip are all linked
    to those within two, and a star through the least of the former holds all that.
    """
    masks = []
    for i, quad in enumerate(QUADS):
        free = [8 * p + b for p in range(8) if p not in quad for b in range(8)]
        for r in range(3):
            masks += [(i, r, sum(1 << b for b in bits) - (1 << 64 if 63 in bits else 0)) for bits in combinations(free, r)]
    masks = long.sparkSession.createDataFrame(masks, "quad int, r int, mask long")
    rows = long.withColumn("quad", F.shiftrightunsigned("key", 32).cast("int")).join(F.broadcast(masks), "quad")
    rows = rows.select("key", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"), "fp", "r")
    hubs = rows.groupBy("key", "variant").agg(F.min(F.when(F.col("r") < 2, F.col("fp"))).alias("hub"), F.count("*").alias("n"))
    return rows.join(hubs.where("hub is not null and n > 1").hint("merge"), ["key", "variant"]).where("hub <> fp").select(F.col("hub").alias("a"), F.col("fp").alias("b")).distinct()


def links(fps: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """``a, b``: links between distinct fingerprints that connect whatever is connected by three differing bits or fewer."""
    index = postings(fps)
    sizes = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = index.join(sizes.hint("merge"), "key")  # tables that grow with the input never go through the driver
    short = shared.where(F.col("n") <= limit).select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return short.mapInArrow(list_links, "a long, b long").union(variant_links(shared.where(F.col("n") > limit).select("key", "fp")))


def near_duplicates(docs: DataFrame, limit: int = LIST_LIMIT) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of ``docs``.

    Null and empty texts have fingerprint zero and are linked like any other. Repeated rows and ties in
    doc_id stay apart as rows and share their component. A null doc_id gets a component like any row; it is
    never the smallest, and a component of null ids alone has a null id. An empty table gives an empty result.
    """
    batches(docs.sparkSession)
    fps = durable(fingerprints(docs))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(links(distinct.select("fp"), limit))
    rooted = distinct.join(roots.hint("merge"), F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    of = rooted.join(smallest.hint("merge"), "root").select("fp", "component_id")
    return fps.join(of.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
