"""Document fingerprints: bottom-k sketches of shingle hashes."""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import batches, rows_of

#: A sketch holds the K smallest of a text's distinct shingle hashes, of 48 bits each; twelve hex digits a hash.
K, SHINGLE, DIGITS = 128, 5, 12
#: Words of a part of a long text.
PART = 1 << 16
SPACE = 1 << (4 * DIGITS)
#: Where rows without an id stand: after all others.
LEAST = -(1 << 63)


def hashes(words: list[bytes]) -> np.ndarray:
    """A hash for each shingle of five words, repeats included; fewer words make one shingle, none make none."""
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    each = np.fromiter((digest(w) for w in words), np.uint64, len(words))
    n, size = len(each), min(SHINGLE, len(each))
    mixed = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + each[i : n - size + 1 + i]
        mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(32)
    return mixed >> np.uint64(64 - 4 * DIGITS)


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together, for parts that are cut between shingles."""
    return np.union1d(a, b)[:k]


def sketch(text: bytes, k: int = K, part: int = PART) -> np.ndarray:
    """A text's sketch; that of a long one is merged from those of its parts, which overlap by a shingle less a word."""
    words = text.split()
    out = np.unique(hashes(words[: part + SHINGLE - 1]))[:k]
    for at in range(part, len(words) - SHINGLE + 1, part):
        out = merge(out, np.unique(hashes(words[at : at + part + SHINGLE - 1]))[:k], k)
    return out


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard likeness: the share of the K smallest hashes of both that each of them has. Two empty texts: 1."""
    both = np.sort(np.concatenate([a, b]))
    again = np.concatenate([both[1:] == both[:-1], [False]]) if len(both) else np.empty(0, bool)
    first = np.concatenate([[True], ~again[:-1]]) if len(both) else again
    low = both[first][:k]
    return float(np.count_nonzero(both[again] <= low[-1]) / len(low)) if len(low) else 1.0


def count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact under K."""
    return float(len(a)) if len(a) < k else (k - 1) * SPACE / (float(a[k - 1]) + 1)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of the first text's shingles that the second has. Of an empty text: 1."""
    if not len(a):
        return 1.0
    both = count(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * both / count(a, k))


def to_text(a: np.ndarray) -> str:
    raw = a.astype(">u8").tobytes()
    return np.frombuffer(raw, np.uint8).reshape(-1, 8)[:, 8 - DIGITS // 2 :].tobytes().hex()


def from_text(text: str) -> np.ndarray:
    return np.array([int(text[i : i + DIGITS], 16) for i in range(0, len(text), DIGITS)], np.uint64)


def fingerprints(docs: DataFrame, k: int = K) -> DataFrame:
    """``docs`` with ``fingerprint`` and ``n_shingles``, each row by itself; a null text counts as empty."""
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("fingerprint", "n_shingles")])

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            all_ = [sketch(t or b"", k) for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([to_text(a) for a in all_], pa.string()), pa.array([count(a, k) for a in all_], pa.float64())], [*batch.schema.names, "fingerprint", "n_shingles"]
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(run, f"{schema}, fingerprint string, n_shingles double")


OUT = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("n_shingles", pa.float64()), ("held_by_next", pa.float64()),
])


def edited(text: str, following: str) -> str:
    """``text`` with its last third (rounded down) replaced by as much of the start of ``following``."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compare_runs(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row against the one after it; rows come by (part, role) and role 1 is the first row of the next part."""
    last: tuple | None = None
    for batch in parts:
        out: dict[str, list] = {f.name: [] for f in OUT}
        columns = (batch.column(c).to_pylist() for c in ("part", "role", "doc_id", "text"))
        for part, role, doc_id, text in zip(*columns, strict=True):
            text = text or ""
            own = sketch(text.encode()) if last and last[0] == part or role == 0 else None
            if last and last[0] == part:
                changed = edited(last[2], text)
                raw = changed.encode()
                other = sketch(raw)
                values = (last[1], len(last[2]), hashlib.sha256(raw).hexdigest(), to_text(last[3]), to_text(other), resemblance(last[3], other), resemblance(last[3], own), count(last[3]), containment(last[3], own))
                for name, value in zip(out, values, strict=True):
                    out[name].append(value)
            last = None if role else (part, doc_id, text, own)
        yield rows_of(out, OUT)


def with_edits(docs: DataFrame) -> DataFrame:
    """The fingerprints of each row's text and of its edited text, and their likeness to each other and to the next row's.

    The next row is the one after it by descending doc_id (ties by a hash of the text, null ids last), and the
    first for the last; an only row follows itself. Null texts count as empty. Rows are dealt to parts
    by ranges of doc_id and that hash, in proportion to their number, and the first row of each part is also sent to the part
    before it: texts move once, and each task reads its rows in order, one after another. Other columns aren't read.
    """
    spark = docs.sparkSession
    batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    parts = max(1, rows.rdd.getNumPartitions())
    place, tie = F.coalesce("doc_id", F.lit(LEAST)), F.xxhash64("text")
    rows = rows.withColumns({"place": place, "tie": tie})
    rows = rows.withColumn("part", part_of(F.struct("place", "tie"), cuts(rows, parts)))
    heads = rows.groupBy("part").agg(F.max(F.struct("place", "tie")).alias("head")).orderBy("part").collect()  # one row a part
    if not heads:
        return spark.createDataFrame([], "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, held_by_next double")
    found = [(h.part, h.head.place, h.head.tie, heads[i - 1].part) for i, h in enumerate(heads)]
    guests = spark.createDataFrame(found, "part int, head_place long, head_tie long, before int")
    joined = rows.join(F.broadcast(guests), "part")  # one row a part
    is_head = (F.col("place") == F.col("head_place")) & (F.col("tie") == F.col("head_tie"))
    seats = F.when(is_head, F.array(F.struct(F.col("part"), F.lit(0).alias("role")), F.struct(F.col("before").alias("part"), F.lit(1).alias("role"))))
    seats = F.coalesce(seats, F.array(F.struct(F.col("part"), F.lit(0).alias("role"))))
    dealt = joined.select("doc_id", "text", "place", "tie", F.explode(seats).alias("seat")).select("seat.*", "doc_id", "text", "place", "tie")
    dealt = dealt.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "role", F.desc("place"), F.desc("tie"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, held_by_next double"
    return dealt.select("part", "role", "doc_id", "text").mapInArrow(compare_runs, schema)


def cuts(rows: DataFrame, parts: int) -> list[tuple[int, int]]:
    """(place, tie) at which rows, in descending order, are cut into about ``parts`` parts of equal numbers of rows.

    A place that several cuts fall on, one id with very many rows (or none), is cut by the hash of the text too.
    """
    if parts < 2:
        return []
    found = Counter(int(b) for b in rows.approxQuantile("place", [i / parts for i in range(1, parts)], 0.25 / parts))
    return sorted(((b, LEAST + (1 << 64) * j // n) for b, n in found.items() for j in range(n)), reverse=True)


def part_of(place: Column, bounds: list[tuple[int, int]]) -> Column:
    """Number of ``bounds`` (descending) above ``place``, a struct of place and tie, by halving."""
    if not bounds:
        return F.lit(0)
    steps, size = [], 1
    while size <= len(bounds):
        steps.append(size)
        size *= 2
    held = F.array(*[F.struct(F.lit(a).cast("long").alias("place"), F.lit(b).cast("long").alias("tie")) for a, b in bounds])

    def halve(low: Column, step: Column) -> Column:
        return low + F.when((low + step <= len(bounds)) & (F.try_element_at(held, low + step) > place), step).otherwise(0)

    return F.aggregate(F.array(*[F.lit(s) for s in steps[::-1]]), F.lit(0), halve)
