"""Repeated byte strings by longest-previous-factor arrays, distributed over content-defined anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import batches, durable, release, rows_of, stored, texts

#: Strings of so many bytes count; anchors are cores of CORE bytes, and every string holds one that its content alone picks.
LENGTH, CORE = 200, 64
REACH = LENGTH - CORE
#: Anchors with up to so many different surroundings are sorted within a task; those with more are settled by aggregates.
GROUP_LIMIT = 32_768
#: Texts are read for anchors in pieces of so many bytes, whatever their length.
PIECE = 1 << 18

ANCHORS = pa.schema([("key", pa.int64()), ("at", pa.int64()), ("core", pa.int64()), ("around", pa.int64())])


def grams(raw: np.ndarray) -> np.ndarray:
    """A mixed 32-bit value for each run of eight bytes."""
    n = len(raw) - 7
    value = np.lib.stride_tricks.as_strided(raw, (n, 8), (1, 1)).copy().view(np.uint64)[:, 0]
    value *= np.uint64(0x9E3779B97F4A7C15)
    value ^= value >> np.uint64(32)
    value *= np.uint64(0xD6E8FEB86659FD93)
    return value >> np.uint64(32)


def least_places(raw: np.ndarray) -> np.ndarray:
    """For each string of LENGTH bytes the place of its core: the leftmost least value among those whose core lies inside."""
    n = len(raw) - CORE + 1
    least, width = (grams(raw)[:n] << np.uint64(32)) | np.arange(n, dtype=np.uint64), 1
    while width * 2 <= REACH + 1:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = REACH + 1 - width
    if rest:
        least = np.minimum(least[:-rest], least[rest:])
    return (least & np.uint64(0xFFFFFFFF)).astype(np.int64)


def changes(at: np.ndarray) -> np.ndarray:
    return at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at


def anchors(text: bytes) -> np.ndarray:
    """Starts of the cores of a text, read in pieces."""
    if len(text) < LENGTH:
        return np.empty(0, np.int64)
    whole = np.frombuffer(text, np.uint8)
    return np.unique(np.concatenate([changes(least_places(whole[s : s + PIECE + LENGTH - 1])) + s for s in range(0, len(text) - LENGTH + 1, PIECE)]))


def all_anchors(documents: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the document, starts of its cores); short texts are read together."""
    together, size = [], 0
    for i, text in enumerate(documents):
        if len(text) >= PIECE:
            yield i, anchors(text)
        elif len(text) >= LENGTH:
            together.append(i)
            size += len(text)
        if together and (size >= PIECE or i == len(documents) - 1):
            lengths = np.array([len(documents[j]) for j in together])
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            places = least_places(np.frombuffer(b"".join([documents[j] for j in together]), np.uint8))
            inside = np.zeros(size + 1, np.int8)  # strings that lie within one document
            inside[starts] += 1
            inside[starts + lengths - LENGTH + 1] -= 1
            at = changes(places[np.cumsum(inside)[: len(places)] > 0])
            cuts = np.searchsorted(at, starts)
            for j, own, start in zip(together, np.split(at, cuts[1:]), starts.tolist(), strict=True):
                yield j, own - start
            together, size = [], 0


def around(text: bytes, at: int) -> tuple[int, int]:
    return max(0, at - REACH), min(len(text), at + LENGTH)


def anchor_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each anchor the hashes of its core and of all that strings holding it can reach (with its place in that)."""
    digest = xxhash.xxh3_64_intdigest
    for batch in parts:
        keys, places, cores, rounds = [], [], [], []
        names, documents = batch.column("key").to_pylist(), texts(batch)
        for i, at in all_anchors(documents):
            key, text = names[i], documents[i]
            spots = at.tolist()
            keys.append(np.full(len(at), key, np.int64))
            places.append(at)
            cores.append(np.fromiter((digest(text[a : a + CORE]) for a in spots), np.uint64, len(spots)))
            rounds.append(np.fromiter((digest(text[max(0, a - REACH) : a + LENGTH], min(a, REACH)) for a in spots), np.uint64, len(spots)))
        if keys:
            yield rows_of({"key": np.concatenate(keys), "at": np.concatenate(places), "core": np.concatenate(cores).view(np.int64), "around": np.concatenate(rounds).view(np.int64)}, ANCHORS)


#: status 0: the surroundings occur again as a whole; 1: they don't, or stand for those that do, and are to be sorted; 2: settled by aggregates.
WHOLE, SORTED, COUNTED = 0, 1, 2


def repeated(found: DataFrame, first: bool = False) -> DataFrame:
    """``key, at, core, around, mixed`` for anchors whose core occurs again; mixed tells whether its surroundings differ.

    Only counts and least values are gathered for a core, and joins on it are inner joins, which Spark splits
    where a core is frequent. With ``first`` also ``head``, the core's first place.
    """
    head = [F.min(F.struct("key", "at")).alias("head")] if first else []
    cores = found.groupBy("core").agg(F.count("*").alias("n"), F.min("around").alias("low"), F.max("around").alias("high"), *head).where("n > 1")
    return found.join(cores.select("core", (F.col("low") != F.col("high")).alias("mixed"), *["head"][: len(head)]), "core")


def statuses(again: DataFrame, limit: int, first: bool = False) -> DataFrame:
    """``key, at, core, status`` for anchors whose core occurs again. With ``first``, first copies are not WHOLE.

    Surroundings count as equal if the 64-bit hashes of their cores and of all of them are: chance needs two collisions, or
    one among the surroundings of one core.
    """
    place = F.struct("key", "at") if first else F.xxhash64("key", "at")
    rounds = again.where("mixed").groupBy("core", "around").agg(F.count("*").alias("n"), F.min(place).alias("first"))
    sizes = rounds.groupBy("core").agg(F.count("*").alias("kinds"))
    rounds = rounds.join(sizes, "core")
    mixed = again.where("mixed").join(rounds, ["core", "around"])
    way = F.when(F.col("kinds") <= limit, SORTED).otherwise(COUNTED)
    same = again.where("not mixed").where(F.col("head") != place if first else F.lit(True)).select("key", "at", "core", F.lit(WHOLE).alias("status"))
    whole = mixed.where((F.col("n") > 1) & ((F.col("first") != place) if first else F.lit(True))).select("key", "at", "core", F.lit(WHOLE).alias("status"))
    single = mixed.where((F.col("n") == 1) | (F.col("first") == place)).select("key", "at", "core", way.alias("status"))
    return same.union(whole).union(single)


CONTEXTS = "key long, core long, at long, `from` long, status int, bytes binary"
CONTEXT_SCHEMA = pa.schema([("key", pa.int64()), ("core", pa.int64()), ("at", pa.int64()), ("from", pa.int64()), ("status", pa.int32()), ("bytes", pa.binary())])


def cut_contexts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The surroundings of each anchor that has to be compared."""
    for batch in parts:
        out: dict[str, list] = {f.name: [] for f in CONTEXT_SCHEMA}
        for key, text, spots in zip(batch.column("key").to_pylist(), texts(batch), batch.column("spots").to_pylist(), strict=True):
            for spot in spots or ():
                if spot["status"] != WHOLE:
                    a, b = around(text, spot["at"])
                    for name, value in (("key", key), ("core", spot["core"]), ("at", spot["at"]), ("from", a), ("status", spot["status"]), ("bytes", text[a:b])):
                        out[name].append(value)
                    if len(out["key"]) >= 5000:
                        yield rows_of(out, CONTEXT_SCHEMA)
                        out = {f.name: [] for f in CONTEXT_SCHEMA}
        yield rows_of(out, CONTEXT_SCHEMA)


class RangeMinimum:
    """Least values of ranges, from tables of ranges of doubling width."""

    def __init__(self, values: np.ndarray, longest: int | None = None) -> None:
        """Ranges up to the length of ``values``, or about ``longest``."""
        self.tables = [values]
        while 2 << len(self.tables) - 1 <= min(len(values), len(values) if longest is None else longest):
            last, width = self.tables[-1], 1 << len(self.tables) - 1
            self.tables.append(np.minimum(last[:-width], last[width:]))

    def least(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least value from ``low`` to ``high``, inclusive."""
        step = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.empty(len(low), self.tables[0].dtype)
        for k in np.unique(step).tolist():
            at = step == k
            out[at] = np.minimum(self.tables[k][low[at]], self.tables[k][high[at] - (1 << k) + 1])
        return out


def nearest_smaller(position: np.ndarray, lcp: np.ndarray, enough: int = 0) -> np.ndarray:
    """For each place in a suffix order the common prefix with the nearest place before it that has a smaller text position, 0 without any.

    ``lcp`` is the common prefix with the place before. Each place passes over stretches of halving length
    that hold no smaller position, and keeps the least prefix on its way. Prefixes under ``enough`` may come out as other
    values under it: no stretch is longer than the longest in which all prefixes reach it.
    """
    n = len(position)
    if not n:
        return lcp
    breaks = np.flatnonzero(np.append(lcp < enough, True)) if enough else np.array([n])
    longest = int(np.diff(breaks, prepend=0).max())
    positions, prefixes = RangeMinimum(position, longest), RangeMinimum(lcp, longest)
    at, low = np.arange(n), lcp.copy()
    for k in range(len(positions.tables) - 1, -1, -1):
        to = at - (1 << k)
        may = np.flatnonzero(to >= 0)
        may = may[positions.tables[k][to[may]] >= position[may]]
        low[may] = np.minimum(low[may], prefixes.tables[k][to[may]])
        at[may] = to[may]
    return np.where((at > 0) & (position[np.maximum(at - 1, 0)] < position), low, 0)


def longest_factors(position: np.ndarray, lcp: np.ndarray, enough: int = 0) -> np.ndarray:
    """Longest previous factors in suffix order: the longest common prefix with any suffix of a smaller text position.

    Of the suffixes with smaller positions the nearest on either side share most. With positions
    reversed, these are the longest next factors.
    """
    after = np.concatenate([[0], lcp[:0:-1]]) if len(lcp) else lcp
    return np.maximum(nearest_smaller(position, lcp, enough), nearest_smaller(position[::-1], after, enough)[::-1])


def sorted_strings(strings: np.ndarray, size: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of zero-padded strings (rows; a width that 8 divides) within groups, and the common prefix of each with the one before, -1 at a group's first."""
    n = len(group)
    order = np.lexsort((size, *strings.reshape(n, -1, 8).copy().view(">u8")[:, ::-1, 0].T, group))
    lcp = np.full(n, -1)
    if n > 1:
        same = strings[order[1:]] == strings[order[:-1]]
        lcp[1:] = np.where(same.all(1), strings.shape[1], np.argmin(same, axis=1))
        lcp[1:] = np.minimum(lcp[1:], np.minimum(size[order[1:]], size[order[:-1]]))
        lcp[1:][group[order[1:]] != group[order[:-1]]] = -1
    return order, lcp


def factors(group: np.ndarray, left: np.ndarray, buffer: np.ndarray, anchor: np.ndarray, size: np.ndarray, first: bool = False) -> np.ndarray:
    """Which strings of LENGTH bytes around anchors occur again within their group: a row for an anchor, a column for its distance to the string's start.

    ``buffer`` holds the surroundings one after another; ``anchor`` tells the place of the core in it, ``left``
    and ``size`` the bytes before it and in all. Rows of a group come by text position. Equal strings have
    their anchor at the same distance, so the suffixes at each distance form a suffix order of their own: by the bytes
    before the anchor (only whether they are equal matters: a prefix that ends there is too short), then by the rest.
    Its common prefixes give the longest previous and next factors, and a string occurs again where one of them reaches
    LENGTH (``first``: only the previous one, so that first copies stay). From one distance to the next the order changes only
    where a common part of two neighbours begins or ends; the factors are worked out at those distances.
    """
    n = len(group)
    out = np.zeros((n, REACH + 2), np.int32)
    if n < 2:
        return out[:, : REACH + 1] > 0
    right = np.minimum(size - left, LENGTH)
    padded = np.concatenate([np.zeros(REACH, np.uint8), buffer, np.zeros(LENGTH, np.uint8)])
    ahead = np.lib.stride_tricks.sliding_window_view(padded, LENGTH)[anchor + REACH]
    order, lcp = sorted_strings(np.where(np.arange(LENGTH) < right[:, None], ahead, 0), right, group)
    back = np.lib.stride_tricks.sliding_window_view(padded, REACH)[anchor][:, ::-1]
    left_order, left_lcp = sorted_strings(np.where(np.arange(REACH) < left[:, None], back, 0), left, group)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    least = RangeMinimum(lcp)
    # (group, distance) where a class of equal bytes before the anchor splits, or one of equal bytes after it grows.
    opens = np.concatenate([group[left_order] * (REACH + 1) + left_lcp + 1, group[order] * (REACH + 1) + np.maximum(0, LENGTH - lcp)])
    fits = np.concatenate([(left_lcp >= 0) & (left_lcp < REACH), (lcp >= 0) & (lcp >= LENGTH - REACH)])
    levels = np.unique(np.concatenate([opens[fits], np.unique(group) * (REACH + 1)]))
    owner, level = levels // (REACH + 1), levels % (REACH + 1)
    until = np.where(np.append(owner[1:] == owner[:-1], False), np.append(level[1:], 0), REACH + 1)
    turn = np.arange(len(levels)) - np.searchsorted(owner, owner)
    for k in range(int(turn.max()) + 1):
        now = np.flatnonzero(turn == k)
        slot = np.searchsorted(owner[now], group)
        slot[slot == len(now)] = 0
        active = owner[now][slot] == group
        low = level[now][slot]
        own = left_order[active[left_order]]
        classes = np.zeros(n, np.int64)
        classes[own] = np.cumsum(left_lcp[active[left_order]] < low[own])
        ends = np.empty(n, np.int64)
        ends[order] = np.cumsum(lcp < LENGTH - low[order])
        rows = np.flatnonzero(active & (left >= low) & (right >= LENGTH - low))
        suffixes = rows[np.argsort(classes[rows] * n + rank[rows])]
        # Only neighbours that share LENGTH bytes can lie on the way to a factor of that length.
        near = (classes[suffixes[1:]] == classes[suffixes[:-1]]) & (ends[suffixes[1:]] == ends[suffixes[:-1]])
        kept = np.append(near, False) | np.append(False, near) if len(suffixes) else near
        pair = np.flatnonzero(np.append(False, near)[kept]) if len(suffixes) else np.empty(0, np.int64)
        suffixes = suffixes[kept]
        if not len(suffixes):
            continue
        common = np.zeros(len(suffixes), np.int64)
        common[pair] = low[suffixes[pair]] + least.least(rank[suffixes[pair - 1]] + 1, rank[suffixes[pair]])
        again = longest_factors(suffixes, common, LENGTH) >= LENGTH
        if not first:
            again |= longest_factors(-suffixes, common, LENGTH) >= LENGTH
        found = suffixes[again]
        out[found, low[found]] += 1
        out[found, until[now][slot[found]]] -= 1
    return np.cumsum(out, axis=1)[:, : REACH + 1] > 0


FOUND = pa.schema([("key", pa.int64()), ("from", pa.int64()), ("to", pa.int64())])


def intervals(flags: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``starts`` order at which runs of set flags begin and end (inclusive)."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return starts[np.flatnonzero(edge == 1)], starts[np.flatnonzero(edge == -1) - 1]


def sort_groups(parts: Iterator[pa.RecordBatch], first: bool = False) -> Iterator[pa.RecordBatch]:
    """Repeated strings as byte ranges, from batches sorted by core, key and place; a core that the batch may not end is carried on."""

    def settle(table: pa.Table) -> pa.RecordBatch:
        cores = table.column("core").to_numpy()
        held = table.column("bytes").to_pylist()
        size = np.array([len(b) for b in held], np.int64)
        begin = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64)
        buffer = np.frombuffer(b"".join(held), np.uint8)
        at, start, keys = table.column("at").to_numpy(), table.column("from").to_numpy(), table.column("key").to_numpy()
        group = np.cumsum(np.concatenate([[0], (cores[1:] != cores[:-1]).astype(np.int64)]))
        flags = factors(group, at - start, buffer, begin + at - start, size, first)
        out: dict[str, list] = {"key": [], "from": [], "to": []}
        for i in np.flatnonzero(flags.any(1)).tolist():
            low, high = intervals(flags[i, ::-1], np.arange(at[i] - REACH, at[i] + 1))
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                out["key"].append(int(keys[i]))
                out["from"].append(a)
                out["to"].append(b + LENGTH)
        return rows_of(out, FOUND)

    waiting: pa.Table | None = None
    for batch in parts:
        one = pa.Table.from_batches([batch])
        waiting = pa.concat_tables([waiting, one]) if waiting is not None else one
        cores = waiting.column("core").to_numpy()
        if len(cores) < 4000:
            continue
        cut = int(np.argmax(cores == cores[-1]))
        if cut:
            yield settle(waiting.slice(0, cut))
            waiting = waiting.slice(cut)
    if waiting is not None and waiting.num_rows:
        yield settle(waiting)


STRINGS = pa.schema([("hash", pa.binary()), ("key", pa.int64()), ("from", pa.int64())])


def string_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every string of LENGTH bytes around an anchor, as a 128-bit hash."""
    for batch in parts:
        for key, at, start, raw in zip(*(batch.column(c).to_pylist() for c in ("key", "at", "from", "bytes")), strict=True):
            spots = range(0, min(at - start, len(raw) - LENGTH) + 1)
            yield rows_of({"hash": [xxhash.xxh3_128_digest(raw[i : i + LENGTH]) for i in spots], "key": [key] * len(spots), "from": [start + i for i in spots]}, STRINGS)


def counted(contexts: DataFrame, first: bool = False) -> DataFrame:
    """The same for anchors with very many surroundings: equal strings meet in an aggregate, no group in a task.

    A string that holds several anchors comes up once for each, so it is places that have to differ.
    """
    strings = contexts.select("key", "at", "from", "bytes").mapInArrow(string_rows, "hash binary, key long, `from` long")
    place = F.struct("key", "from") if first else F.xxhash64("key", "from")
    more = strings.groupBy("hash").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low <> high").select("hash", "low")
    again = strings.join(more, "hash")
    if first:
        again = again.where(place != F.col("low"))
    return again.select("key", "from", (F.col("from") + LENGTH).alias("to"))


def merged(spans: list[dict], n: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted((max(0, s["from"]), min(n, s["to"])) for s in spans):
        if b <= a:
            continue
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def with_repeats(docs: DataFrame, limit: int = GROUP_LIMIT, first: bool = False) -> DataFrame:
    """``docs`` (columns key and text) with ``spots`` and ``ranges``: what is covered by strings of LENGTH bytes that start anywhere else too.

    Every string holds an anchor that only its content picks, so equal strings share a core at the same
    distance. Surroundings that occur twice are repeated as a whole and need only their count; those that
    differ while their core is shared are cut out of the texts and sorted.
    """
    spark = docs.sparkSession
    found = docs.select("key", "text").mapInArrow(anchor_rows, "key long, at long, core long, around long")
    again, drop = stored(repeated(found, first))
    release(spark)
    spots = durable(statuses(again, limit, first).groupBy("key").agg(F.collect_list(F.struct("at", "core", "status")).alias("spots")))
    drop()
    del found, again
    release(spark)
    # Both uses of the texts read one and the same exchange.
    spotted = docs.join(spots, "key", "left")
    contexts = spotted.mapInArrow(cut_contexts, CONTEXTS)
    ordered = contexts.where(F.col("status") == SORTED).repartition("core").sortWithinPartitions("core", "key", "at")
    ranges = ordered.mapInArrow(lambda parts: sort_groups(parts, first), "key long, `from` long, `to` long")
    if spots.where(F.exists("spots", lambda s: s["status"] == COUNTED)).limit(1).count():
        ranges = ranges.union(counted(contexts.where(F.col("status") == COUNTED), first))
    ranges = ranges.groupBy("key").agg(F.collect_list(F.struct("from", "to")).alias("ranges"))
    return spotted.join(ranges, "key", "left")


CUT = pa.schema([("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))), ("kept", pa.binary())])


def cut_spans(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges each row's ranges and cuts them out."""
    for batch in parts:
        sizes, spans, kept = [], [], []
        for text, spots, ranges in zip(texts(batch), batch.column("spots").to_pylist(), batch.column("ranges").to_pylist(), strict=True):
            n = len(text)
            whole = [{"from": max(0, s["at"] - REACH), "to": s["at"] + LENGTH} for s in spots or () if s["status"] == WHOLE and n >= LENGTH]
            whole = [s for s in whole if min(n, s["to"]) - s["from"] >= LENGTH]
            gone = merged(whole + (ranges or []), n)
            at, pieces = 0, []
            for a, b in gone:
                pieces.append(text[at:a])
                at = b
            pieces.append(text[at:])
            sizes.append(n)
            spans.append([{"from": a, "to": b} for a, b in gone])
            kept.append(b"".join(pieces))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, CUT.field("spans").type), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
        )


def remove_repeats(docs: DataFrame, limit: int = GROUP_LIMIT, first: bool = False) -> DataFrame:
    """``doc_id, n_bytes, spans, kept`` for each row of ``docs``: whole texts without every repeated string of LENGTH bytes, first copies included.

    With ``first``, first copies stay: a string goes if it has an earlier place, by the rows' hashes and then
    within the text. Null texts count as empty; texts under LENGTH bytes stay whole. Repeated rows are copies of each other,
    and so lose all that is LENGTH bytes or longer. Rows with one doc_id and different texts stay apart. An
    empty table gives an empty result.
    """
    batches(docs.sparkSession, 500)
    keyed = docs.select("doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    spotted = with_repeats(keyed, limit, first).select("doc_id", "text", "spots", "ranges")
    return spotted.mapInArrow(cut_spans, f"doc_id {kind}, n_bytes long, spans array<struct<`from`: long, `to`: long>>, kept binary")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for each row of ``docs``."""
    out = remove_repeats(docs)
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["to"] - s["from"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
