"""Benchmark decontamination by latent semantic retrieval and longest-common-subsequence checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import batches, release, texts, trim
from foliant.llm.tokens import bytes_of, split, words_of

#: Latent dimensions and the extra columns of the random sketch; the decomposition is fitted on all documents and all benchmark items.
RANK, EXTRA, SEED = 384, 16, 5
#: Up to so many terms a task adds up their products in a table of terms by terms (its upper part, 67 MB at most, multiplied by so many
#: rows at a time), and beyond by columns of the sketch.
TABLE_TERMS, STRIP = 4096, 256
#: Words of a passage for the decomposition; search moves windows of two blocks and more by one block.
PASSAGE, BLOCK, PIECE = 32, 8, 16_384
#: Words in more than this share of the documents have no weight, but for items that would keep less than half of theirs: all words
#: of these have a weight of FLOOR at least. Items are compared in groups of so many.
COMMON, FLOOR, GROUP = 0.2, 0.5, 256
#: A window is a candidate from this cosine and this covered part of the item's latent weight on.
COSINE, COVER = 0.35, 0.35
#: A candidate is a leak if so much of the item's words come in order, or so much with so much of the answer (its last words).
LCS, LCS_WITH_ANSWER, ANSWER, ANSWER_WORDS = 0.7, 0.5, 0.75, 8
#: An item of which the space holds a smaller part (of its norm) is searched by its own words besides.
HELD = 0.7
#: Whatever the space: windows with so many words of an item in a row are read, if a tenth of the item comes in such runs.
RUN = 3
#: Benchmarks up to so many bytes, items, and words times items go to each executor at once; longer ones are searched in several runs,
#: so that the driver's and a task's tables of words by items stay under some 100 MB.
BENCHMARK_BYTES, PART_ITEMS, PART_CELLS = 32 << 20, 1024, 24 << 20

PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))


def plain(text: bytes) -> list[bytes]:
    """Words without ASCII punctuation, A-Z in lower case."""
    return text.translate(PLAIN).split()


def lcs(masks: dict[bytes, int], n: int, words: list[bytes]) -> int:
    """Length of the longest common subsequence, by bit-parallel columns; ``masks`` has a bit for each place of a word."""
    full = (1 << n) - 1
    v = full
    for w in words:
        u = v & masks.get(w, 0)
        if u:
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def masks_of(words: list[bytes]) -> dict[bytes, int]:
    out: dict[bytes, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


class Terms:
    """Places of the words of many texts in a list of terms, without a Python object for a word."""

    def __init__(self, terms: list[bytes]) -> None:
        joined = np.frombuffer(b" ".join(terms), np.uint8)
        hashes = words_of(0, joined, np.array([0, len(joined)])).hashes
        self.order = np.argsort(hashes)
        self.keys = hashes[self.order]
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[hashes >> np.uint64(44)] = True
        self.plain = np.frombuffer(PLAIN, np.uint8)

    def read(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """The words of a batch's texts as ``plain`` has them, in order (-1: no term), and how many each text has."""
        raw, offsets = bytes_of(batch)
        sizes, held = np.zeros(len(offsets) - 1, np.int64), [np.empty(0, np.int64)]
        for words in split(self.plain[raw], offsets):
            sizes[words.first : words.first + len(words.counts)] += words.counts
            ids = np.full(len(words.hashes), -1)
            at = np.flatnonzero(self.maybe[words.hashes >> np.uint64(44)])
            wanted = words.hashes[at]
            slot = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
            ids[at] = np.where(self.keys[slot] == wanted, self.order[slot], -1)
            held.append(ids)
        return np.concatenate(held), sizes


def document_frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many of all documents each term occurs, and the number of documents."""
    held = docs.sparkSession.sparkContext.broadcast(terms)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide, known = len(held.value), Terms(held.value)
        n, batch = np.zeros(wide + 1, np.int64), None
        for batch in parts:
            ids, sizes = known.read(batch)
            text = np.repeat(np.arange(len(sizes)), sizes)
            n[:-1] += np.bincount(np.unique((text * wide + ids)[ids >= 0]) % wide, minlength=wide)
            n[-1] += batch.num_rows
        some = np.flatnonzero(n)
        known = batch = None
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["term", "n"])

    counts = docs.select("text").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    out = np.zeros(len(terms) + 1, np.int64)
    for r in counts.collect():  # a row for each term of the benchmark at most
        out[r.term] = r.n
    return out[:-1], int(out[-1])


def term_weights(terms: list[bytes], items: list[list[bytes]], df: np.ndarray, n: int) -> np.ndarray:
    """Inverse document frequencies; zero for common words, unless an item needs them, as one that many documents hold."""
    full = np.maximum(np.log((n + 1) / (df + 1)) + 1e-3, FLOOR)
    weights = np.where(df > COMMON * max(n, 1), 0.0, full)
    ids = {t: i for i, t in enumerate(terms)}
    own = [np.array([ids[w] for w in words]) for words in items]
    needed = [i for i in own if weights[i].sum() < full[i].sum() / 2]
    for i in needed:
        weights[i] = full[i]
    return weights


def passages(ids: np.ndarray, sizes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms with weight and the numbers of their passages (ascending), of texts of ``sizes`` words; a word that repeats the one before it doesn't count."""
    ids = np.where(weights[ids] > 0, ids, -1)  # -1 has some weight or none and stays -1
    starts = np.cumsum(sizes) - sizes
    again = np.concatenate([[False], ids[1:] == ids[:-1]])[: len(ids)]
    again[starts[sizes > 0]] = False
    known = np.flatnonzero((ids >= 0) & ~again)
    many = -(-sizes // PASSAGE)
    number = np.arange(len(ids)) - np.repeat(starts, sizes)
    number = number // PASSAGE + np.repeat(np.cumsum(many) - many, sizes)
    return ids[known], number[known]


def rows_at(n: int) -> np.ndarray:
    """For each row of the upper part of a table of ``n`` by ``n``, held in one line, what gives a cell's place when its column is added."""
    row = np.arange(n)
    return row * n - row * (row + 1) // 2


def products(table: np.ndarray, ids: np.ndarray, at: np.ndarray, weights: np.ndarray) -> None:
    """Adds to ``table``, the upper part in one line, A'A of passages, terms by terms before their weights, half of it on the diagonal; arguments as in ``sketched``."""
    if not len(ids):
        return
    rows = rows_at(len(weights))
    new = np.concatenate([[False], at[1:] != at[:-1]])
    local = np.cumsum(new)
    share = 1 / np.bincount(local, weights[ids] ** 2)[local]
    np.add.at(table, rows[ids] + ids, share / 2)
    for apart in range(1, min(PASSAGE, len(ids))):
        met = np.flatnonzero(local[apart:] == local[:-apart])
        if not len(met):
            break
        a, b = ids[met], ids[met + apart]
        np.add.at(table, rows[np.minimum(a, b)] + np.maximum(a, b), share[met])


def multiplied(table: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The whole table of ``products`` times ``x``, without ever holding more of it than its line and some rows."""
    n, rows, out = len(x), rows_at(len(x)), np.zeros_like(x)
    for first in range(0, n, STRIP):
        last = min(first + STRIP, n)
        strip = np.zeros((last - first, n - first))
        for r in range(first, last):
            strip[r - first, r - first :] = table[rows[r] + r : rows[r] + n]
        out[first:last] += strip @ x[first:]
        out[first:] += strip.T @ x[first:last]
        del strip  # before the next one is made
    return out


def sketched(ids: np.ndarray, at: np.ndarray, weights: np.ndarray, omega: np.ndarray) -> np.ndarray:
    """A'A omega for passages given as terms ``ids`` with passage numbers ``at`` (ascending); passages have length 1."""
    out = np.zeros_like(omega)
    if not len(ids):
        return out
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    local = np.cumsum(np.concatenate([[0], (at[1:] != at[:-1]).astype(np.int64)]))
    w = weights[ids]
    w = w / np.sqrt(np.bincount(local, w * w))[local]
    y = np.add.reduceat(omega[ids] * w[:, None], first, axis=0)
    order = np.argsort(ids, kind="stable")
    rows = y[local[order]] * w[order, None]
    sorted_ids = ids[order]
    start = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    out[sorted_ids[start]] = np.add.reduceat(rows, start, axis=0)
    return out


def pieces(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of about PIECE terms that end with a passage."""
    first = 0
    while first < len(at):
        last = int(np.searchsorted(at, at[min(first + PIECE, len(at)) - 1], side="right"))
        yield first, last
        first = last


def latent_space(docs: DataFrame, n_docs: int, items: list[np.ndarray], terms: list[bytes], weights: np.ndarray, fit_docs: int | None = None, rank: int = RANK, most: int = TABLE_TERMS) -> np.ndarray:
    """Right singular vectors of the TF-IDF passages, by a randomised decomposition in one distributed pass over all documents.

    A caller can give a number of documents to be about as many as are read (a hash of doc_id chooses them). Each task multiplies its passages with the same random matrix and back; the products, of one size whatever
    the input, are added up in a tree of tasks. Benchmark items weigh as much in all as the documents' passages.
    """
    width = min(rank + EXTRA, len(terms))
    omega = np.random.default_rng(SEED).normal(size=(len(terms), width)).astype(np.float32)
    held = docs.sparkSession.sparkContext.broadcast((terms, weights.astype(np.float32), SEED, width))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, w, seed, wide = held.value
        known, w = Terms(words), w.astype(np.float64)
        rand = np.random.default_rng(seed).normal(size=(len(words), wide)).astype(np.float32)
        table = np.zeros(len(words) * (len(words) + 1) // 2) if len(words) <= most else None
        total, n, batch, ids, at = np.zeros_like(rand), 0, None, None, None
        for batch in parts:
            ids, at = passages(*known.read(batch), w)
            for first, last in pieces(at):
                if table is None:
                    total += sketched(ids[first:last], at[first:last], w, rand)
                else:
                    products(table, ids[first:last], at[first:last], w)
            n += len(np.unique(at))
        if table is not None:
            total = (w[:, None] * multiplied(table, w[:, None] * rand)).astype(np.float32)
        table = rand = known = batch = ids = at = None
        trim()
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([n], pa.int64())], ["z", "n"])

    def add(a: tuple[bytes, int], b: tuple[bytes, int]) -> tuple[bytes, int]:
        return (np.frombuffer(a[0], np.float32) + np.frombuffer(b[0], np.float32)).tobytes(), a[1] + b[1]

    read = docs.select("text")
    if fit_docs is not None and fit_docs < n_docs:
        read = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(fit_docs / n_docs * (1 << 20))).select("text")
    zero = (np.zeros_like(omega).tobytes(), 0)
    z, n = read.mapInArrow(run, "z binary, n long").rdd.map(lambda r: (bytes(r.z), r.n)).treeAggregate(zero, add, add, depth=3)
    z = np.frombuffer(z, np.float32).reshape(omega.shape).astype(np.float64)
    own = np.concatenate(items) if items else np.empty(0, np.int64)
    at = np.repeat(np.arange(len(items)), [len(i) for i in items])
    z = z + max(n, 1) / max(len(items), 1) * sketched(own, at, weights, omega.astype(np.float64))
    # With z = A'A omega and b = omega'A'A omega, A'A is close to z b^-1 z': its eigenvectors are the right singular vectors.
    b = omega.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((b + b.T) / 2)
    good = values > values.max(initial=0) * 1e-9
    left, sizes, _ = np.linalg.svd(z @ (vectors[:, good] / np.sqrt(values[good])), full_matrices=False)
    return left[:, :rank][:, sizes[:rank] > 0].astype(np.float32)


class Index:
    """What a task needs to search: term weights, and for each item its words and its vectors' share of each term; ``owner`` has the item of each vector, all items' latent ones first."""

    def __init__(self, terms: list[bytes], weights: np.ndarray, item_ids: list, item_words: list[list[bytes]], affinity: np.ndarray, owner: np.ndarray) -> None:
        self.ids = {t: i for i, t in enumerate(terms)}
        self.weighed = np.append(weights > 0, False)  # the last for words that no item has
        self.runs = self.word_runs(item_words)
        self.energy = (weights * weights).astype(np.float32)
        self.item_ids, self.words = item_ids, item_words
        self.masks = [masks_of(w) for w in item_words]
        self.tails = [w[-min(ANSWER_WORDS, max(1, len(w) // 3)) :] for w in item_words]
        self.tail_masks = [masks_of(t) for t in self.tails]
        self.blocks = [2] * len(item_words)
        for i, w in enumerate(item_words):
            while self.blocks[i] * BLOCK < len(w):
                self.blocks[i] *= 2
        self.most = max(self.blocks, default=2)
        self.groups = []
        for start in range(0, len(owner), GROUP):
            group, columns = owner[start : start + GROUP], affinity[:, start : start + GROUP]  # badly held items have two columns
            latent = columns * weights[:, None]
            size = np.linalg.norm(columns, axis=0)
            classes = [(k, np.array([i for i, g in enumerate(group) if self.blocks[g] == k])) for k in sorted({self.blocks[g] for g in group})]
            self.groups.append((group, (latent / np.maximum(size, 1e-9)).astype(np.float32), np.maximum(size, 1e-9).astype(np.float32), classes))

    def word_runs(self, item_words: list[list[bytes]]) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, sorted keys, first entry of each key, items, places): the runs of RUN words of all items; shorter items are a run."""
        entries: dict[int, list[tuple[int, int, int]]] = {}
        for i, words in enumerate(item_words):
            k, ids = min(RUN, len(words)), [self.ids[w] for w in words]
            for place in range(len(words) - k + 1):
                key = 0
                for x in ids[place : place + k]:
                    key = key * len(self.ids) + x
                entries.setdefault(k, []).append((key, i, place))
        out = []
        for k, found in sorted(entries.items()):
            table = np.array(sorted(found), np.int64)
            keys, starts = np.unique(table[:, 0], return_index=True)
            out.append((k, keys, np.append(starts, len(table)), table[:, 1], table[:, 2]))
        return out

    def copies(self, held: list, first: np.ndarray) -> list[tuple]:
        """Leaks among the windows that have runs of an item's words, wherever they lie in the latent space."""
        line = np.full(first[-1] * BLOCK, -1, np.int64)
        for (_, _, _, _, raw), at in zip(held, first[:-1].tolist(), strict=True):
            line[at * BLOCK : at * BLOCK + len(raw)] = raw
        out = []
        lengths = np.array([len(w) for w in self.words])
        for k, keys, starts, owners, places in self.runs:
            known = line >= 0
            for j in range(1, k):
                known[:-j] &= line[j:] >= 0
                known[-j:] = False
            at = np.flatnonzero(known)
            key = line[at]
            for j in range(1, k):
                key = key * len(self.ids) + line[at + j]
            slot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            at, slot = at[keys[slot] == key], slot[keys[slot] == key]
            n = starts[slot + 1] - starts[slot]
            entry = np.repeat(starts[slot] - np.cumsum(n) + n, n) + np.arange(n.sum())
            at, item, place = np.repeat(at, n), owners[entry], places[entry]
            piece = np.searchsorted(first * BLOCK, at, side="right") - 1
            order = np.lexsort((at, piece, item))
            at, item, place, piece = at[order], item[order], place[order], piece[order]
            need = np.maximum(1, lengths[item] // 10)
            last = np.arange(len(at)) + need - 1
            enough = last < len(at)
            last = np.minimum(last, len(at) - 1)
            enough &= (item[last] == item) & (piece[last] == piece) & (at[last] - at <= lengths[item] * 3 // 2)
            begins = np.unique(np.stack([item, piece, at - first[piece] * BLOCK - place], 1)[enough], axis=0)
            before = (-1, -1, 0)
            for i, p, begin in begins.tolist():
                if (i, p) == before[:2] and begin - before[2] <= lengths[i] // 4:
                    continue  # what the margin of the window before covers
                before = (i, p, begin)
                doc, offset, ids, words, _ = held[p]
                found = self.read(i, words, offset + begin, False)
                if found:
                    out.append((doc, i, self.cosine(i, ids[max(0, begin) : max(0, begin) + self.blocks[i] * BLOCK]), *found))
        return out

    def cosine(self, item: int, ids: np.ndarray) -> float:
        ids = ids[ids >= 0]
        energy = float(self.energy[ids].sum())
        return min(1.0, max(0.0, float(self.groups[item // GROUP][1][ids, item % GROUP].sum()) / energy**0.5)) if energy else 0.0

    def search(self, documents: list[bytes]) -> list[tuple[int, int, float, float, float]]:
        """(document, item, cosine, part of the item in order, part of its answer) of each leak; documents and items by place."""
        out, held, waiting = [], [], 0
        step, get = PIECE - self.most * BLOCK, self.ids.get
        for i, text in enumerate(documents):
            words = plain(text)
            raw = np.array([get(w, -1) for w in words], np.int64)
            ids = np.where(self.weighed[raw], raw, -1)
            ids[1:][ids[1:] == ids[:-1]] = -1
            for start in range(0, max(1, len(ids)), max(step, BLOCK)):
                held.append((i, start, ids[start : start + PIECE], words, raw[start : start + PIECE]))
                waiting += len(held[-1][2]) + self.most * BLOCK
                if start + PIECE >= len(ids):
                    break
            if waiting >= PIECE:
                out += self.candidates(held)
                held, waiting = [], 0
        out += self.candidates(held)
        best: dict[tuple[int, int], tuple] = {}
        for doc, item, *found in out:
            if (doc, item) not in best or best[doc, item] < (found[1], found[2], found[0]):
                best[doc, item] = (found[1], found[2], found[0])
        return [(d, i, cosine, part, answer) for (d, i), (part, answer, cosine) in sorted(best.items())]

    def candidates(self, held: list) -> list[tuple]:
        if not held:
            return []
        sizes = [-(-len(ids) // BLOCK) + self.most for _, _, ids, _, _ in held]
        first = np.concatenate([[0], np.cumsum(sizes)])
        line = np.full(first[-1] * BLOCK, -1, np.int64)
        for (_, _, ids, _, _), at in zip(held, first[:-1].tolist(), strict=True):
            line[at * BLOCK : at * BLOCK + len(ids)] = ids
        out = self.copies(held, first)
        known = np.flatnonzero(line >= 0)
        if not len(known):
            return out
        ids, block = line[known], known // BLOCK
        energy = np.bincount(block, self.energy[ids], first[-1]).astype(np.float32)
        start = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
        for group, latent, size, classes in self.groups:
            sums = np.zeros((first[-1], len(group)), np.float32)
            sums[block[start]] = np.add.reduceat(latent[ids], start, axis=0)
            for blocks, members in classes:
                s, e, width = sums[:, members], energy, 1
                while width < blocks:
                    s, e, width = s[:-width] + s[width:], e[:-width] + e[width:], width * 2
                near = (s >= COVER * size[members]) & (s >= (COSINE * np.sqrt(e))[:, None])
                at, item = np.nonzero(near)
                if len(at):
                    piece = np.searchsorted(first, at, side="right") - 1
                    cosine = s[at, item] / np.sqrt(e[at])
                    out += self.verified(held, first, group[members[item]], piece, at, cosine, s[at, item])
        return out

    def verified(self, held: list, first: np.ndarray, items: np.ndarray, pieces: np.ndarray, at: np.ndarray, cosine: np.ndarray, weight: np.ndarray) -> list[tuple]:
        """Leaks among candidate windows, read word by word: of each stretch of windows the heaviest.

        A stretch of an item of ``n`` words is ``n // 4`` words long at most, which the margin covers, so that what any of its
        windows holds is read. The heaviest of each run of windows that touch is a stretch of its own.
        """
        out = []
        order = np.lexsort((at, pieces, items))
        new = (np.diff(items[order], prepend=-1) != 0) | (np.diff(pieces[order], prepend=-1) != 0)
        apart = new | (np.diff(at[order], prepend=-1) > np.array(self.blocks)[items[order]])
        tops = {int(run[np.argmax(weight[run])]) for run in np.split(order, np.flatnonzero(apart)[1:])}
        reach = [len(self.words[i]) // 4 // BLOCK for i in items[order].tolist()]
        starts, begin = [], 0
        for j, (fresh, place) in enumerate(zip(new.tolist(), at[order].tolist(), strict=True)):
            if fresh or place - begin > reach[j]:
                starts.append(j)
                begin = place
        stretches = {int(run[np.argmax(weight[run])]) for run in np.split(order, starts[1:])}
        for top in sorted(stretches | tops):
            item, (doc, offset, _, words, _) = int(items[top]), held[pieces[top]]
            found = self.read(item, words, offset + int(at[top] - first[pieces[top]]) * BLOCK, top in tops)
            if found:
                out.append((doc, item, float(min(1.0, cosine[top])), *found))
        return out

    def read(self, item: int, words: list[bytes], begin: int, whole: bool) -> tuple[float, float] | None:
        """Parts of the item and of its answer that the window from word ``begin`` on has in order, if it is a leak.

        Where many windows are read, chance finds the answer and half of the item somewhere in one of them; so unless
        ``whole``, both have to be in a passage of two items' length.
        """
        n = len(self.words[item])
        margin = n // 4 + BLOCK
        window = words[max(0, begin - margin) : max(0, begin + self.blocks[item] * BLOCK + margin)]
        part = lcs(self.masks[item], n, window) / n
        if part < LCS_WITH_ANSWER:
            return None
        answer = lcs(self.tail_masks[item], len(self.tails[item]), window) / len(self.tails[item])
        if part >= LCS or answer < ANSWER or whole:
            return (part, answer) if part >= LCS or answer >= ANSWER else None
        passages = [window[i : i + 2 * n] for i in range(0, max(1, len(window) - 2 * n + 1), max(1, n // 8))] + [window[-2 * n :]]
        read = [(lcs(self.masks[item], n, p) / n, lcs(self.tail_masks[item], len(self.tails[item]), p) / len(self.tails[item])) for p in passages]
        return max((r for r in read if r[0] >= LCS_WITH_ANSWER and r[1] >= ANSWER), default=None)


def prepared(docs: DataFrame, benchmark: DataFrame, fit_docs: int | None, rank: int) -> list[tuple]:
    """The pieces of one Index for each part of the benchmark that fits an executor."""
    rows = benchmark.where("text is not null").select("item_id", F.col("text").cast("binary").alias("raw"))
    size, count = rows.agg(F.sum(F.length("raw")), F.count("*")).first()
    # A part of p has at most size / 4 / p distinct words and about count / p items.
    runs = max(-(-(size or 0) // BENCHMARK_BYTES), -(-count // PART_ITEMS), int(((size or 0) / 4 * count / PART_CELLS) ** 0.5))
    out = []
    release(docs.sparkSession)  # what made ``docs`` may have filled the executors
    for i in range(runs):
        part = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(runs)) == i) if runs > 1 else rows
        got = sorted({(r.item_id, bytes(r.raw)) for r in part.collect()}, key=lambda r: (r[0] is None, r))
        items = [(k, w) for k, raw in got if (w := plain(raw))]
        if not items:
            continue
        terms = sorted({w for _, words in items for w in words})
        df, n = document_frequencies(docs, terms)
        weights = term_weights(terms, [w for _, w in items], df, n)
        ids = {t: j for j, t in enumerate(terms) if weights[j] > 0}
        coded_items = [np.array([ids[w] for w in words if w in ids], np.int64) for _, words in items]
        space = latent_space(docs, n, [c for c in coded_items if len(c)], terms, weights, fit_docs, rank)
        vectors = np.zeros((len(terms), len(items)), np.float32)
        for j, own in enumerate(coded_items):
            np.add.at(vectors[:, j], own, weights[own])
        affinity = space @ (space.T @ vectors)
        badly = np.flatnonzero(np.linalg.norm(affinity, axis=0) < HELD * np.linalg.norm(vectors, axis=0))
        affinity = np.concatenate([affinity, vectors[:, badly]], 1)
        out.append((terms, weights, [k for k, _ in items], [w for _, w in items], affinity, np.concatenate([np.arange(len(items)), badly])))
    return out


def leaks(docs: DataFrame, benchmark: DataFrame, fit_docs: int | None = None, rank: int = RANK) -> DataFrame:
    """``doc_id, item_id, cosine, in_order, answer``: a row for each document and each benchmark item that it holds.

    ``in_order`` is the part of the item's words that the best window has in their order, ``answer`` that of its
    last words. All items are queries, all documents are searched, whole. Null and empty texts, and items without a word,
    have no leaks; repeated rows have the same leaks each, and so have rows that share a doc_id; an empty benchmark or an empty table gives
    an empty result. Of windows of a document that hold as much of an item, that with most of its answer counts, then that with the largest
    cosine. Other columns aren't read; texts of any length are searched by pieces that overlap.
    """
    spark = docs.sparkSession
    batches(spark)
    doc, item = (t.schema[c].dataType.simpleString() for t, c in ((docs, "doc_id"), (benchmark, "item_id")))
    schema = f"doc_id {doc}, item_id {item}, cosine double, in_order double, answer double"
    out = spark.createDataFrame([], schema)
    for pieces in prepared(docs, benchmark, fit_docs, rank):
        held = spark.sparkContext.broadcast(pieces)
        kind = pa.int64() if item == "bigint" else None

        def run(parts: Iterator[pa.RecordBatch], held=held, kind=kind) -> Iterator[pa.RecordBatch]:
            index = Index(*held.value)
            for batch in parts:
                found = index.search(texts(batch))
                values = [batch.column("doc_id").take(pa.array([f[0] for f in found], pa.int64())), pa.array([index.item_ids[f[1]] for f in found], kind), *(pa.array([round(f[i], 4) for f in found], pa.float64()) for i in (2, 3, 4))]
                yield pa.RecordBatch.from_arrays(values, ["doc_id", "item_id", "cosine", "in_order", "answer"])
            batch = index = None
            trim()

        out = out.union(docs.select("doc_id", "text").mapInArrow(run, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, fit_docs: int | None = None, rank: int = RANK) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item, with their columns, whatever their names; texts are not shuffled.

    Null and empty texts stay, repeated rows stay or go together, an empty table stays empty, as all does with an empty benchmark.
    """
    batches(docs.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    out = docs
    for pieces in prepared(docs, benchmark, fit_docs, rank):
        held = docs.sparkSession.sparkContext.broadcast(pieces)

        def run(parts: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            index = Index(*held.value)
            for batch in parts:
                clean = np.ones(batch.num_rows, bool)
                clean[[f[0] for f in index.search(texts(batch))]] = False
                yield batch.filter(pa.array(clean))
            batch = index = None
            trim()

        out = out.mapInArrow(run, schema)
    return out
