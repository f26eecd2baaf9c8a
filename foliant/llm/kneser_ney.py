"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import batches, durable, release, shared_folder, small, trim
from foliant.llm.tokens import bytes_of, split, words_of

#: The model goes in shards of about so many trigrams, by a hash of their middle word; documents meet it so many words at a time.
SHARD, CHUNK = 1 << 20, 5 << 20
#: Up to so many ids of documents to fit on go to each executor, so that texts aren't shuffled to find them; more are joined.
SENT_IDS = 4_000_000
#: A document is rejected above this quantile of its language's trusted documents, plus so many nats; a language needs so many of them.
QUANTILE, MARGIN, LEAST_TRUSTED = 0.99, 0.0, 30
START, END = "\x01", "\x02"


@dataclass
class Model:
    """Sorted keys and values of the trigram model. Word ids are places in ``words``; an unknown word has the id after the last."""

    words: list[bytes]
    uni: np.ndarray
    back1: np.ndarray
    keys2: np.ndarray
    own2: np.ndarray
    back2: np.ndarray
    keys3: np.ndarray
    own3: np.ndarray


def planes(a: np.ndarray) -> bytes:
    """Bytes of an array, all first bytes of its items before all second ones, which compresses better."""
    return np.ascontiguousarray(a.view(np.uint8).reshape(len(a), -1).T).tobytes()


def unplaned(raw: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(kind)[:, 0]


def packed(m: Model) -> bytes:
    """The model for the executors: keys as their differences, shares in single precision, compressed."""
    keys = [planes(np.diff(k, prepend=0)) for k in (m.keys2, m.keys3)]
    shares = [planes(a.astype(np.float32)) for a in (m.uni, m.back1, m.own2, m.back2, m.own3)]
    return zlib.compress(pickle.dumps((m.words, keys, shares)), 1)


def unpacked(raw: bytes) -> Model:
    words, keys, shares = pickle.loads(zlib.decompress(raw))
    keys2, keys3 = (np.cumsum(unplaned(k, np.int64)) for k in keys)
    uni, back1, own2, back2, own3 = (unplaned(s, np.float32) for s in shares)
    return Model(words, uni.astype(np.float64), back1, keys2, own2, back2, keys3, own3)


def tally(counts: np.ndarray) -> np.ndarray:
    """How many of ``counts`` are one, two, three and four."""
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5]


def discounts(tallied: np.ndarray) -> np.ndarray:
    """D1, D2 and D3+ from the numbers of n-grams that occur one to four times; 0.5 where those don't tell."""
    n = np.asarray(tallied, float)
    if not n[0] or not n[1]:
        return np.array([0.5, 0.5, 0.5])
    y = n[0] / (n[0] + 2 * n[1])
    d = [i + 1 - (i + 2) * y * n[i + 1] / n[i] if n[i] else 0.5 for i in range(3)]
    return np.clip(d, 0.05, [0.95, 1.95, 2.95])


def smooth(context: np.ndarray, contexts: int, counts: np.ndarray, steps: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Discounted share of each n-gram within its context, and the weight that each context leaves to the shorter one; ``steps`` are discounts of more counts than these."""
    d = (discounts(tally(counts)) if steps is None else steps)[np.minimum(counts, 3) - 1]
    total = np.bincount(context, counts, contexts)
    left = np.bincount(context, d, contexts)
    seen = total > 0
    return (counts - d) / total[context], np.where(seen, left / np.where(seen, total, 1), 1.0)


def fit(words: list[bytes], trigrams: np.ndarray, counts: np.ndarray) -> Model:
    """The model of ``trigrams`` (rows of three word ids) with ``counts``."""
    v = len(words) + 1
    pairs, inverse = np.unique(trigrams[:, 1] * v + trigrams[:, 2], return_inverse=True)
    seen2 = np.bincount(inverse, minlength=len(pairs))  # by how many words a pair is preceded
    start = words.index(START.encode())
    keys2 = np.union1d(pairs, [start * v + start])
    n2 = np.zeros(len(keys2), np.int64)
    n2[np.searchsorted(keys2, pairs)] = seen2
    real = n2 > 0
    n1 = np.bincount(pairs % v, minlength=v)
    some = np.flatnonzero(n1)
    share, left = smooth(np.zeros(len(some), np.int64), 1, n1[some])
    uni = np.full(v, left[0] / v)
    uni[some] += share
    own2, back1 = np.zeros(len(keys2)), np.ones(v)
    own2[real], back1 = smooth((keys2 // v)[real], v, n2[real])
    context = np.searchsorted(keys2, trigrams[:, 0] * v + trigrams[:, 1])
    keys3 = context * v + trigrams[:, 2]
    order = np.argsort(keys3)
    own3, back2 = smooth(context[order], len(keys2), counts[order])
    return Model(words, uni, back1, keys2, own2, back2, keys3[order], own3)


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in sorted ``keys``, -1 where missing."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1) if len(keys) else np.full(len(wanted), -1)


class Scorer:
    """Sums of -log p for many texts at once."""

    def __init__(self, model: Model) -> None:
        self.m = model
        joined = np.frombuffer(b" ".join(model.words), np.uint8)
        hashes = words_of(0, joined, np.array([0, len(joined)])).hashes
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.unknown = len(model.words)
        self.start, self.end = model.words.index(START.encode()), model.words.index(END.encode())

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.order[at], self.unknown)

    def tokens(self, ids: np.ndarray) -> np.ndarray:
        """-log p of each id from the third on, given the two before it."""
        m, v = self.m, self.unknown + 1
        a = find(m.keys2, ids[:-1] * v + ids[1:])
        before, pair = a[:-1], a[1:]
        last = ids[2:]
        p = m.back1[ids[1:-1]] * m.uni[last] + np.where(pair >= 0, m.own2[pair], 0)
        known = np.flatnonzero(before >= 0)
        p[known] *= m.back2[before[known]]
        at = find(m.keys3, before[known] * v + last[known])
        p[known] += np.where(at >= 0, m.own3[at], 0)
        return -np.log(p)

    def score(self, raw: np.ndarray, offsets: np.ndarray, chunk: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
        """Sum of -log p and number of predicted tokens (words and the end) for each text, whole.

        All texts stand in one line, each after two starts and before an end; it is read by pieces that overlap by two.
        """
        sizes, held = np.zeros(len(offsets) - 1, np.int64), [np.empty(0, np.int64)]
        for words in split(raw, offsets):
            held.append(self.ids(words.hashes))
            sizes[words.first : words.first + len(words.counts)] += words.counts
        ids = np.concatenate(held)
        ends = np.cumsum(sizes + 3)
        starts = ends - sizes - 3
        line = np.full(int(ends[-1]) if len(ends) else 0, self.start)
        line[np.arange(len(ids)) + np.repeat(starts + 2 - np.cumsum(sizes) + sizes, sizes)] = ids
        line[ends - 1] = self.end
        nats = np.zeros(len(line) + 1)
        for at in range(2, len(line), chunk):
            piece = line[at - 2 : at + chunk]
            nats[at + 1 : at + len(piece) - 1] = self.tokens(piece)
        total = np.cumsum(nats)
        return total[ends] - total[starts + 2], sizes + 1


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of documents that are labelled good and not toxic, once each."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0").select("doc_id").distinct()


def chosen(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids of the documents to fit on: all trusted ones outside of the fourth that always judges; of these the ``limit`` with the least hash, where a caller gives one."""
    trusted = trusted_ids(labels).where("doc_id is not null").withColumn("h", F.xxhash64("doc_id")).where("pmod(h, 4) <> 0")
    return (trusted if limit is None else trusted.orderBy("h", "doc_id").limit(limit)).select("doc_id")


def mark(text: str) -> np.uint64:
    return words_of(0, np.frombuffer(text.encode(), np.uint8), np.array([0, len(text)])).hashes[0]


def lined(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in one line, each text after two starts and before an end; places after the ends, and numbers of words."""
    sizes, held = np.zeros(len(offsets) - 1, np.int64), [np.empty(0, np.uint64)]
    for words in split(raw, offsets):
        held.append(words.hashes)
        sizes[words.first : words.first + len(words.counts)] += words.counts
    ends = np.cumsum(sizes + 3)
    line = np.full(int(ends[-1]) if len(ends) else 0, mark(START))
    line[np.arange(sizes.sum()) + np.repeat(ends - sizes - 1 - np.cumsum(sizes) + sizes, sizes)] = np.concatenate(held)
    line[ends - 1] = mark(END)
    return line, ends, sizes


def squeezed(*arrays: np.ndarray) -> bytes:
    """Whole numbers of 0 and more, by their bytes, without those that are zero throughout, compressed."""
    out = []
    for a in arrays:
        a = a.astype(np.uint64)
        wide = (int(a.max(initial=0)).bit_length() + 7) // 8
        out.append((len(a), [(a >> np.uint64(8 * i)).astype(np.uint8).tobytes() for i in range(wide)]))
    raw = pickle.dumps(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def loosened(raw: bytes) -> list[np.ndarray]:
    """The arrays of ``squeezed``, in 32 bits where three bytes hold them, else in 64; without a sign where the last byte is in use."""
    out = []
    for size, layers in pickle.loads(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)):
        a = np.zeros(size, np.int32 if len(layers) < 4 else np.int64 if len(layers) < 8 else np.uint64)
        for i, layer in enumerate(layers):
            a |= np.left_shift(np.frombuffer(layer, np.uint8), 8 * i, dtype=a.dtype)
        out.append(a)
    return out


def shard_of(middle: np.ndarray, shards: int) -> np.ndarray:
    return ((middle >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def counted(v: np.ndarray, u: np.ndarray, w: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, ...]:
    """Distinct trigrams, by middle, first and last word (``v``, ``u``, ``w``: ids below ``size``): middle and first word of each context, how many trigrams it has; last words of these, and sums of ``n``."""
    contexts, context = np.unique(v * size + u, return_inverse=True)
    keys, at = np.unique(context * size + w, return_inverse=True)
    n = np.bincount(at, n, len(keys)).astype(np.int64)
    return contexts // size, contexts % size, np.bincount(keys // size, minlength=len(contexts)), keys % size, n


def dealt(line: np.ndarray, firsts: np.ndarray, shards: int) -> Iterator[tuple[int, bytes]]:
    """(shard, its words and its trigrams with their counts) of a line whose texts begin at ``firsts``."""
    words, place = np.unique(line, return_inverse=True)
    inside = np.ones(len(line), bool)
    inside[firsts] = inside[firsts + 1] = False
    at = np.flatnonzero(inside)
    numbers = shard_of(words, shards)
    order = np.argsort(numbers, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    middle, first, sizes, last, n = counted(rank[place[at - 1]], place[at - 2], place[at], np.ones(len(at)), len(words))
    middle = order[middle]
    found, begins = np.unique(numbers[middle], return_index=True)  # contexts stand by shard
    ends, upto = np.append(begins[1:], len(middle)), np.concatenate([[0], np.cumsum(sizes)])
    for number, a, b in zip(found.tolist(), begins.tolist(), ends.tolist(), strict=True):
        c, d = upto[a], upto[b]
        used, places = np.unique(np.concatenate([middle[a:b], first[a:b], last[c:d]]), return_inverse=True)
        m, f, x = np.split(places, [b - a, 2 * (b - a)])
        yield number, squeezed(np.diff(words[used], prepend=np.uint64(0)), np.diff(m, prepend=0), f, sizes[a:b], x, n[c:d])


def fitted(parts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """A shard of the model from its parts: words, contexts, trigrams and the pairs that end them, with counts; tallies of both."""
    parts = [loosened(raw) for raw in parts]
    hashes = [np.cumsum(p[0], dtype=np.uint64) for p in parts]
    words = np.unique(np.concatenate(hashes))
    ids = [np.searchsorted(words, h) for h in hashes]
    v = np.concatenate([np.repeat(i[np.cumsum(p[1])], p[3]) for i, p in zip(ids, parts, strict=True)])
    u = np.concatenate([np.repeat(i[p[2]], p[3]) for i, p in zip(ids, parts, strict=True)])
    w = np.concatenate([i[p[4]] for i, p in zip(ids, parts, strict=True)])
    n = np.concatenate([p[5] for p in parts])
    del parts, hashes, ids
    middle, first, sizes, last, n = counted(v, u, w, n, len(words))
    del v, u, w
    pairs, n2 = np.unique(np.repeat(middle, sizes) * len(words) + last, return_counts=True)
    model = squeezed(np.diff(words, prepend=np.uint64(0)), np.diff(middle, prepend=0), first, sizes, last, n, np.diff(pairs // len(words), prepend=0), pairs % len(words), n2)
    return model, tally(n), tally(n2)


def preceded(model: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The last words of a shard's pairs, and before each how many middle words stand."""
    parts = loosened(model)
    n = np.bincount(parts[7])
    some = np.flatnonzero(n)
    return np.cumsum(parts[0], dtype=np.uint64)[some], n[some]


@dataclass
class Fitted:
    """Where the shards and the words of a model lie, how many shards it has, discounts of trigrams and of pairs."""

    folder: str
    shards: int
    steps3: np.ndarray
    steps2: np.ndarray
    filled: frozenset[int]

    def rows(self, part: str) -> pa.Table:
        """A part of the model, read from the folder that driver and executors share."""
        where = f"{self.folder}/{part}"
        system, path = (None, where[5:]) if where.startswith("file:/") and not where.startswith("file://") else pa.fs.FileSystem.from_uri(where) if "://" in where else (None, where)
        return pa.parquet.read_table(path, filesystem=system, partitioning=None)


def with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows that have one of these ids; texts are not shuffled for up to SENT_IDS of them."""
    sent = ids.limit(SENT_IDS + 1).count() <= SENT_IDS
    return docs.join(F.broadcast(ids) if sent else ids.hint("merge"), "doc_id", "left_semi")


def train(docs: DataFrame, ids: DataFrame) -> Fitted | None:
    """Fits the model on all documents with these ids; None if there is none.

    Trigrams are dealt by a hash of their middle word to shards of about SHARD, so that a shard has all that the shares of its trigrams,
    contexts and pairs depend on, but for the discounts and the words' own shares, which come from counts over all shards.
    """
    spark = docs.sparkSession
    sample = with_ids(docs.select("doc_id", "text"), ids).select("text").where("text is not null")
    size = sample.agg(F.sum(F.octet_length("text") / 6 + 1)).first()[0]
    if size is None:
        return None
    shards = int(size // SHARD) + 1

    def deal(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(lines: list) -> Iterator[pa.RecordBatch]:
            begins = np.cumsum([0] + [len(line) for line, _ in lines])
            firsts = np.concatenate([f + b for (_, f), b in zip(lines, begins, strict=False)])
            for number, part in dealt(np.concatenate([line for line, _ in lines]), firsts, shards):
                yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([part], pa.binary())], ["shard", "part"])

        lines, waiting = [], 0
        for batch in parts:
            line, ends, sizes = lined(*bytes_of(batch))
            lines.append((line, ends - sizes - 3))
            waiting += len(line)
            if waiting >= SHARD:
                yield from flush(lines)
                lines, waiting = [], 0
        if waiting:
            yield from flush(lines)
        del lines
        trim()

    def fit_shard(key: tuple, rows: pa.Table) -> pa.Table:
        model, three, two = fitted(rows.column("part").to_pylist())
        trim()
        return pa.table({"shard": [key[0].as_py()], "model": pa.array([model], pa.binary()), "three": [three.tolist()], "two": [two.tolist()]})

    def listed(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            for raw in batch.column("model").to_pylist():
                last, n = preceded(raw)
                yield pa.RecordBatch.from_arrays([pa.array(last.view(np.int64)), pa.array(n)], ["word", "n"])
        trim()

    shared_folder(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    kinds = "model binary, three array<long>, two array<long>"
    parts = sample.mapInArrow(deal, "shard long, part binary").groupBy("shard").applyInArrow(fit_shard, f"shard long, {kinds}")
    parts.write.partitionBy("shard").parquet(f"{folder}/shards")
    del parts
    release(spark)  # what was shuffled goes before more is
    made = spark.read.schema(f"{kinds}, shard long").parquet(f"{folder}/shards")
    made.select("model").mapInArrow(listed, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).write.parquet(f"{folder}/words")
    tallies = made.select("three", "two", "shard").collect()  # a row for each shard
    three, two = (discounts(np.sum([r[i] for r in tallies], axis=0)) for i in range(2))
    return Fitted(folder, shards, three, two, frozenset(r.shard for r in tallies))


class Sharded:
    """Sums of -log p for many texts at once, by a model in shards. Word ids are places in ``words``; an unknown word has the id after the last."""

    def __init__(self, model: Fitted) -> None:
        self.model = model
        rows = model.rows("words")
        words, n = rows.column("word").to_numpy().view(np.uint64), rows.column("n").to_numpy()
        steps, total = discounts(tally(n)), n.sum()
        rest = steps[np.minimum(n, 3) - 1].sum() / total / (len(n) + 2)  # all words, the start, and one for unknown words
        share = ((n - steps[np.minimum(n, 3) - 1]) / total + rest).astype(np.float32)
        if not (words == mark(START)).any():
            words, share = np.append(words, mark(START)), np.append(share, np.float32(rest))
        order = np.argsort(words)
        self.words, self.share = words[order], np.append(share[order], np.float32(rest))
        self.of = np.append(shard_of(self.words, model.shards), -1).astype(np.int16 if model.shards < 1 << 15 else np.int32)
        del rows, words, n, share, order
        trim()

    def ids(self, line: np.ndarray) -> np.ndarray:
        words, place = np.unique(line, return_inverse=True)
        found = find(self.words, words)
        return np.where(found >= 0, found, len(self.words)).astype(np.int32)[place]

    def shard(self, number: int) -> list[np.ndarray]:
        """Its words; keys of trigrams, contexts and pairs, with the shares or weights of each; weights of middle words. Keys are of its own word ids."""
        raw = self.model.rows(f"shards/shard={number}").column("model")[0].as_py()
        grow, middle, first, sizes, last, n3, middle2, last2, n2 = loosened(raw)
        del raw
        words, size = np.cumsum(grow, dtype=np.uint64), len(grow)
        contexts = np.cumsum(middle) * size + first
        keys3 = np.repeat(np.arange(len(contexts)) * size, sizes) + last
        del grow, middle, first, last
        starts = np.cumsum(sizes) - sizes
        d, total = self.model.steps3[np.minimum(n3, 3) - 1], np.add.reduceat(n3, starts, dtype=np.int64)
        back2 = np.add.reduceat(d, starts) / total
        own3 = ((n3 - d) / np.repeat(total, sizes)).astype(np.float32)
        del n3, d, total, starts, sizes
        middle2 = np.cumsum(middle2)
        own2, back1 = smooth(middle2, size, n2, self.model.steps2)
        return [words, keys3, own3, contexts, back2.astype(np.float32), middle2 * size + last2, own2.astype(np.float32), back1.astype(np.float32)]

    def sums(self, line: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Sum of -log p of each text's words and end, for texts that begin at ``firsts`` in a line of word ids."""
        p = self.share[line]
        p[firsts] = p[firsts + 1] = 1.0  # the starts, which are given
        shard = np.full(len(line), -1, self.of.dtype)
        shard[1:] = self.of[line[:-1]]
        shard[firsts] = shard[firsts + 1] = -1
        order = np.argsort(shard, kind="stable").astype(np.int32)
        numbers, first = np.unique(shard, return_counts=True)
        del shard
        for number, rows in zip(numbers.tolist(), np.split(order, np.cumsum(first)[:-1]), strict=True):
            if number in self.model.filled:
                shard = self.shard(number)
                for at in range(0, len(rows), 1 << 17):  # a frequent word can bring all rows to one shard
                    some = rows[at : at + (1 << 17)]
                    p[some] = self.shares(shard, p[some], *(line[some - back] for back in (2, 1, 0)))
                del shard
        del order
        np.log(p, out=p)
        return -np.add.reduceat(p, firsts, dtype=np.float64)

    def shares(self, shard: list[np.ndarray], p: np.ndarray, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """p of words ``w`` after ``u`` and ``v``, whose middle words are of ``shard``, from their own shares ``p``."""
        words, keys3, own3, contexts, back2, keys2, own2, back1 = shard
        size, asked, local = len(words), np.zeros(len(self.words) + 1, bool), np.full(len(self.words) + 1, -1, np.int32)
        asked[u] = asked[v] = asked[w] = True
        some = np.flatnonzero(asked[:-1])
        local[some] = find(words, self.words[some])
        u, v, w = (local[x].astype(np.int64) for x in (u, v, w))
        del asked, local, some
        p = p * np.where(v >= 0, back1[v], np.float32(1))
        pair = find(keys2, np.where((v >= 0) & (w >= 0), v * size + w, -1))
        p += np.where(pair >= 0, own2[pair], np.float32(0))
        context = find(contexts, np.where((v >= 0) & (u >= 0), v * size + u, -1))
        known = np.flatnonzero(context >= 0)
        context, w = context[known], w[known]
        whole = find(keys3, np.where(w >= 0, context * size + w, -1))
        p[known] = p[known] * back2[context] + np.where(whole >= 0, own3[whole], np.float32(0))
        return p


def scores(docs: DataFrame, model: Fitted | None, row: str | None = None, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns those to ``keep``) with ``nats`` a token (perplexity is its exponential) of ``text``, or of that field of a column of rows; null without a model.

    A task reads the shards one after the other for about CHUNK words of its documents at a time, so that neither is bounded by its memory.
    """
    keep = docs.columns if keep is None else keep
    if model is None:
        return docs.select(*keep, F.lit(None).cast("double").alias("nats"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer, held, lines, waiting = None, [], [], 0

        def scored() -> Iterator[pa.RecordBatch]:
            line = np.concatenate(lines)
            lines.clear()
            trim()
            sizes = np.concatenate([sizes for _, sizes in held])
            nats = scorer.sums(line, np.cumsum(sizes + 3) - sizes - 3)
            del line
            for batch, sizes in held:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.round(nats[: len(sizes)] / (sizes + 1), 4))], [*batch.schema.names, "nats"])
                nats = nats[len(sizes) :]
            held.clear()

        for batch in parts:
            if not batch.num_rows:
                continue
            scorer = scorer or Sharded(model)
            line, _, sizes = lined(*bytes_of(batch, "text", row))
            held.append((batch.select(keep), sizes))
            lines.append(scorer.ids(line))
            waiting += len(line)
            del batch, line
            if waiting >= CHUNK:
                yield from scored()
                waiting = 0
        if held:
            yield from scored()
        scorer = None
        trim()

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.mapInArrow(run, f"{schema}, nats double")


def thresholds(scored: DataFrame, labels: DataFrame, ids: DataFrame, quantile: float = QUANTILE, margin: float = MARGIN) -> DataFrame:
    """``every, lang, limit``: the quantile of a language's trusted documents that the model was not fitted on, for scores of two digits.

    Scores are counted by value, so that a language's documents never meet in one task. The row with
    ``every`` is over all languages, for those with few trusted documents.
    """
    trusted = trusted_ids(labels).join(ids, "doc_id", "left_anti")
    of = scored.join(trusted, "doc_id").where("nats is not null")
    counts = of.groupBy("lang", F.round(F.col("nats"), 2).alias("v")).agg(F.count("*").alias("n"))
    counts = counts.select(F.lit(False).alias("every"), "lang", "v", "n").union(counts.groupBy("v").agg(F.sum("n").alias("n")).select(F.lit(True), F.lit(None), "v", "n"))
    run = Window.partitionBy("every", "lang").orderBy("v")
    counts = counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy("every", "lang"))})
    out = counts.where(F.col("upto") >= F.col("all") * quantile).groupBy("every", "lang").agg((F.min("v") + margin).alias("limit"), F.max("all").alias("trusted"))
    return out.where(F.col("every") | (F.col("trusted") >= LEAST_TRUSTED))


def decide(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """``scored`` (with ``lang`` and ``nats``) with ``limit``, its language's, else the one over all, else null, and ``keep``.

    What has no score or no limit stays.
    """
    own = limits.where("not every").select(F.col("lang").alias("of"), F.col("limit").alias("own"))
    every = limits.where("every").agg(F.max("limit").alias("every")).first()[0]
    out = scored.join(own, F.col("lang").eqNullSafe(F.col("of")), "left")
    out = out.withColumn("limit", F.coalesce("own", F.lit(every).cast("double"))).drop("of", "own")
    return out.withColumn("keep", F.coalesce(F.col("nats") <= F.col("limit"), F.lit(True)))


def classify(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """``doc_id, lang, nats, perplexity, threshold, keep`` for each row of ``docs``.

    A document goes if its nats a token are above its language's limit; a score at the limit stays. Null and empty texts have one token,
    the end, and are judged by it. A null language is a language of its own. Without any trusted document
    nothing is known: scores are null and every document stays, as where no limit is known. Repeated rows are judged alike,
    very long texts by pieces, other columns aren't read. An empty table gives an empty result.
    """
    batches(docs.sparkSession)
    ids = chosen(labels, limit)
    model = train(docs, ids)
    scored = durable(scores(docs.select("doc_id", "lang", "text"), model, keep=["doc_id", "lang"]))
    judged = decide(scored, small(thresholds(scored, labels, ids)))
    return judged.select("doc_id", "lang", "nats", F.exp("nats").alias("perplexity"), F.exp("limit").alias("threshold"), "keep")


def keep_good(docs: DataFrame, labels: DataFrame, limit: int | None = None) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with their columns, whatever their names; decisions are those of ``classify``.

    Trusted texts that the model was not fitted on are scored for the limits, and all for the decisions: what a run keeps is then neither stored nor shuffled.
    """
    batches(docs.sparkSession)
    ids = chosen(labels, limit)
    model = train(docs, ids)
    if model is None:
        return docs
    judges = trusted_ids(labels).join(ids, "doc_id", "left_anti").where("doc_id is not null")
    first = durable(scores(with_ids(docs.select("doc_id", "lang", "text"), judges), model, keep=["doc_id", "lang"]))
    limits = small(thresholds(first, labels, ids))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    judged = decide(scores(rows, model, "row").select("row", F.col("row.lang").alias("lang"), "nats"), limits)
    return judged.where("keep").select("row.*")
