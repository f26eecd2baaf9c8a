"""Masked pseudo-likelihood: a bidirectional window network predicts every token from both sides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import batches, rows_of, stored
from foliant.llm.tokens import bytes_of, split

#: Words with an id of their own: the most frequent ones, as many as the square root of all tokens; rarer words share SHAPES ids by their last byte.
LEAST_WORDS, SHAPES, CLASSES = 1024, 64, 64
#: Tokens to each side, widths of the network, minibatch, seed.
SIDE, WIDTH, HIDDEN, BATCH, SEED = 2, 16, 16, 4096, 11
OFFSETS = np.array([o for o in range(-SIDE, SIDE + 1) if o])
EDGE = 0
#: Training goes in rounds from a common mean; a round's steps for the tokens' vectors and for all else.
RATES = ((4.0, 2.0), (4.0, 1.5), (3.0, 1.0), (2.0, 0.5))
#: Texts come to training in runs of so many tokens, which are shuffled; logarithms are added up as whole multiples of 1 / UNIT.
RUN, UNIT = 1 << 16, 1 << 20
COUNTS = pa.schema([("word", pa.int64()), ("n", pa.int64())])
#: Classes of bytes as context in spelling: letters in either case, digits, marks, the two kinds of bytes beyond ASCII, the rest.
MARKS, EDGE_CLASS = 32, 32
CONTEXTS = MARKS * (MARKS + 1)


def byte_classes() -> np.ndarray:
    out = np.full(256, 31, np.int64)
    for i in range(26):
        out[[65 + i, 97 + i]] = i
    out[48:58] = 26
    out[list(b".,;:!?")] = 27
    out[list(b"'\"()[]{}<>-_/")] = 28
    out[128:192], out[192:] = 29, 30
    return out


BYTE_CLASS = byte_classes()


def shape(last: np.ndarray) -> np.ndarray:
    return (last & 63).astype(np.int64) + 1


def count_words(parts: Iterator[pa.RecordBatch], most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Counts of words by their hash within a task, let go in between so that the table stays bounded."""
    held, waiting = [], 0

    def counted() -> pa.RecordBatch:
        word, n = np.unique(np.concatenate(held or [np.empty(0, np.uint64)]), return_counts=True)
        return rows_of({"word": word.view(np.int64), "n": n}, COUNTS)

    for batch in parts:
        for words in split(*bytes_of(batch)):
            held.append(words.hashes)
            waiting += len(words.hashes)
            if waiting >= most:
                yield counted()
                held, waiting = [], 0
    yield counted()


class Vocabulary:
    """Ids of tokens (0 is the edge of a text, then shapes, then words), their classes, and their share within a class.

    p(token) = p(class | both sides) p(id | class), and for a word without an id also p(word | shape): its last
    byte within the shape, then the bytes before it, each given the two after it. Classes hold about equal shares
    of the square roots of the counts, frequent ids first, so that the most frequent ids have classes of their own.
    """

    def __init__(self, words: np.ndarray, counts: np.ndarray, last_bytes: np.ndarray) -> None:
        """``words``: hashes; ``last_bytes``: of all other tokens, how many end with each byte."""
        order = np.argsort(words)
        self.keys, self.ids = words[order], order + 1 + SHAPES
        self.size = 1 + SHAPES + len(words)
        n = np.zeros(self.size)
        rest = last_bytes + 1.0
        np.add.at(n, shape(np.arange(256)), rest)
        self.last = np.log(rest / n[shape(np.arange(256))])
        n[1 + SHAPES :] = counts
        order = np.argsort(-n, kind="stable")[:-1]  # the edge, which has no count, is never predicted
        share = np.cumsum(np.sqrt(n[order]))
        self.classes = np.zeros(self.size, np.int64)
        self.classes[order] = np.minimum((share - np.sqrt(n[order]) / 2) / share[-1] * CLASSES, CLASSES - 1).astype(np.int64)
        total = np.bincount(self.classes, n, CLASSES)
        self.within = np.log(np.maximum(n, 1e-9) / np.maximum(total[self.classes], 1e-9))
        self.prior = np.log(np.maximum(total, 0.5) / max(total.sum(), 1))
        self.kind = np.uint16 if self.size < 1 << 16 else np.int32

    def encode(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the places of the words without one."""
        at = np.minimum(np.searchsorted(self.keys, hashes), max(0, len(self.keys) - 1))
        known = self.keys[at] == hashes if len(self.keys) else np.zeros(len(hashes), bool)
        rare = np.flatnonzero(~known)
        out = self.ids[at] if len(self.keys) else np.zeros(len(hashes), np.int64)
        out[rare] = shape(hashes[rare])
        return out.astype(self.kind), rare


def spelled(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each byte of a word the code of what comes before it (a byte, or 0x20 for the word's start) and of its context: itself and the byte after it."""
    own = BYTE_CLASS[raw]
    after = np.full(len(raw), EDGE_CLASS)
    after[:-1] = own[1:]
    after[ends - 1] = EDGE_CLASS
    before = np.full(len(raw), 0x20)
    before[1:] = raw[:-1]
    before[starts] = 0x20
    return (own * (MARKS + 1) + after) * 256 + before


def spelling(codes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log p of each code, in whole units, from its counts: given two bytes, smoothed by those given one, smoothed evenly."""
    n = np.zeros(CONTEXTS * 256)
    n[codes] = counts
    n = n.reshape(MARKS, MARKS + 1, 256)
    one = n.sum(1) + 0.05
    one /= one.sum(1, keepdims=True)
    two = (n + 4 * one[:, None]) / (n.sum(2, keepdims=True) + 4)
    return np.round(np.log(two).ravel() * UNIT).astype(np.int64)


def start(vocabulary: Vocabulary) -> dict[str, np.ndarray]:
    """The same small random weights wherever training starts; the output's bias is the classes' share."""
    rng, wide = np.random.default_rng(SEED), len(OFFSETS) * WIDTH
    return {
        "vectors": rng.normal(0, 0.1, (vocabulary.size, WIDTH)).astype(np.float32), "mix": rng.normal(0, 2 * wide**-0.5, (wide, HIDDEN)).astype(np.float32), "bias": np.zeros(HIDDEN, np.float32),
        "out": rng.normal(0, 0.1, (CLASSES, HIDDEN)).astype(np.float32), "prior": vocabulary.prior.astype(np.float32),
    }


def forward(w: dict[str, np.ndarray], sides: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Inputs, hidden layer, weights of the classes (a row for a class) and their sums, for rows of the tokens on both sides."""
    x = w["vectors"].take(sides.ravel(), axis=0).reshape(len(sides), -1)
    hidden = x @ w["mix"]
    hidden += w["bias"]
    np.tanh(hidden, out=hidden)
    mass = w["out"] @ hidden.T
    mass += w["prior"][:, None]
    np.exp(mass, out=mass)  # hidden is within 1, "out" within 4: no overflow
    return x, hidden, mass, np.ones(CLASSES, np.float32) @ mass


def step(w: dict[str, np.ndarray], sides: np.ndarray, wanted: np.ndarray, rate: tuple[float, float]) -> None:
    """One step of gradient descent on a minibatch; what concerns one token is gathered by sorting."""
    n = len(wanted)
    x, hidden, slope, total = forward(w, sides)
    slope *= 1 / total
    slope[wanted, np.arange(n)] -= 1
    back = slope.T @ w["out"]
    back *= 1 - hidden * hidden
    inputs = (back @ w["mix"].T).reshape(-1, WIDTH)
    by = np.float32(rate[1] / n)
    w["out"] -= by * (slope @ hidden)
    np.clip(w["out"], -4, 4, out=w["out"])
    w["prior"] -= by * slope.sum(1)
    w["bias"] -= by * back.sum(0)
    w["mix"] -= by * (x.T @ back)
    flat = sides.ravel()
    order = np.argsort(flat, kind="stable")
    ids = flat[order]
    first = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    sums = np.add.reduceat(inputs.take(order, axis=0), first, axis=0)
    # Frequent tokens take the mean of their slopes at this rate, rare ones a share of it.
    share = rate[0] / np.sqrt(n * np.diff(np.append(first, len(ids))))
    w["vectors"][ids[first]] -= sums * share.astype(np.float32)[:, None]


def windows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens with edges between texts, and the places of the tokens."""
    pad = np.full(SIDE, EDGE, texts[0].dtype)
    line = np.concatenate([pad, *[x for t in texts for x in (t, pad)]])
    return line, np.flatnonzero(line != EDGE)


class Shard:
    """A copy of the common weights that learns from one shard, in the order of its rows."""

    def __init__(self, common: dict[str, np.ndarray], vocabulary: Vocabulary, rate: tuple[float, float]) -> None:
        self.common, self.w, self.rate = common, {k: x.copy() for k, x in common.items()}, rate
        self.classes = vocabulary.classes
        self.seen = np.zeros(vocabulary.size, np.int64)
        self.rng, self.held, self.waiting = np.random.default_rng(SEED), [], 0

    def read(self, tokens: np.ndarray) -> None:
        self.held.append(tokens)
        self.waiting += len(tokens)
        if self.waiting >= RUN:
            self.learn()

    def learn(self) -> None:
        if not self.waiting:
            return
        line, at = windows(self.held)
        sides, wanted = line[at[:, None] + OFFSETS], self.classes[line[at]]
        self.seen += np.bincount(line[at], minlength=len(self.seen))
        order = self.rng.permutation(len(at))
        for s in range(0, len(order), BATCH):
            some = order[s : s + BATCH]
            step(self.w, sides[some], wanted[some], (self.rate[0] * len(some) / BATCH, self.rate[1] * len(some) / BATCH))
        self.held, self.waiting = [], 0

    def moved(self) -> np.ndarray:
        """Whole units by which the weights moved, times the tokens that moved them, and these numbers, in one line.

        Whole numbers add up to the same sums in any order.
        """
        self.learn()
        seen = self.seen.copy()
        n = seen[EDGE + 1 :].sum()
        seen[EDGE] = n
        parts = [seen]
        for name, x in self.w.items():
            units = np.round((x - self.common[name]).astype(np.float64) * UNIT).astype(np.int64)
            parts.append((units * (seen[:, None] if name == "vectors" else n)).ravel())
        return np.concatenate(parts)


def averaged(common: dict[str, np.ndarray], total: np.ndarray) -> dict[str, np.ndarray]:
    """The common weights after a round: each token's vector moves by the mean of the shards, weighted by how often they saw the token."""
    size = len(common["vectors"])
    seen, at, out = total[:size], size, {}
    n = max(int(seen[EDGE]), 1)
    for name, x in common.items():
        units = total[at : at + x.size].reshape(x.shape)
        by = np.maximum(seen, 1)[:, None] if name == "vectors" else n
        out[name] = (x + units / by / UNIT).astype(np.float32)
        at += x.size
    return out


def vocabulary_of(docs: DataFrame, words: int | None = None) -> tuple[Vocabulary, int]:
    """Counts every word of every text; the most frequent have ids of their own, of the rest the last bytes are counted. Also the number of tokens."""
    rows = docs.select("text").mapInArrow(count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts, drop = stored(rows)
    by_last = counts.groupBy(F.col("word").bitwiseAND(F.lit(255)).alias("last")).agg(F.sum("n").alias("n")).collect()  # 256 rows at most
    last = np.zeros(256, np.int64)
    for r in by_last:
        last[r["last"]] = r.n
    tokens = int(last.sum())
    limit = words or max(LEAST_WORDS, int(tokens**0.5))
    top = counts.orderBy(F.desc("n"), "word").limit(limit).toPandas()  # bounded by the square root of the tokens
    drop()
    known, n = top["word"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    np.subtract.at(last, (known & np.uint64(255)).astype(np.int64), n)
    return Vocabulary(known, n, last), tokens


CODED = pa.schema([("shard", pa.int32()), ("place", pa.int64()), ("piece", pa.int32()), ("tokens", pa.binary()), ("n", pa.int64())])


def encoder(vocabulary: Vocabulary, shards: int):
    """A function over batches of ``row`` (a hash of a row) and ``text``: tokens of pieces of texts, dealt to shards, and counts of spelling codes of words without an id (shard -1)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = np.zeros(CONTEXTS * 256, np.int64)
        for batch in parts:
            out: dict[str, list] = {f.name: [] for f in CODED}
            rows = batch.column("row").to_numpy()
            before, piece = -1, 0
            for words in split(*bytes_of(batch)):
                ids, rare = vocabulary.encode(words.hashes)
                inside = np.zeros(len(words.raw) + 1, np.int8)
                inside[words.starts[rare]] += 1
                inside[words.ends[rare]] -= 1
                codes += np.bincount(spelled(words.raw, words.starts, words.ends)[np.cumsum(inside)[:-1] > 0], minlength=len(codes))
                ends = np.cumsum(words.counts)
                for i, (a, b) in enumerate(zip((ends - words.counts).tolist(), ends.tolist(), strict=True)):
                    row = words.first + i
                    piece = piece if row == before else 0
                    before = row
                    for s in range(a, b, RUN // 4):
                        place = int(rows[row])
                        out["shard"].append((place ^ piece * 0x9E3779B1) % shards)
                        out["place"].append(place)
                        out["piece"].append(piece)
                        out["tokens"].append(ids[s : min(b, s + RUN // 4)].tobytes())
                        out["n"].append(0)
                        piece += 1
            yield rows_of(out, CODED)
        some = np.flatnonzero(codes)
        yield rows_of({"shard": np.full(len(some), -1), "place": some, "piece": np.zeros(len(some)), "tokens": [b""] * len(some), "n": codes[some]}, CODED)

    return run


def train(docs: DataFrame, vocabulary: Vocabulary, tokens: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The network's weights and the spelling's log-probabilities, from all tokens.

    Texts are encoded once and dealt by a hash of their row to shards, whose number depends on the number of tokens
    alone, in rounds. A shard learns in the order of the hashes from the mean of the round before; moves are added
    up as whole numbers in a tree of tasks. So neither the partitions nor the order of rows change the weights,
    and what a task or the driver holds is a few networks, however many shards there are.
    """
    context, rounds = docs.sparkSession.sparkContext, len(RATES)
    each = max(1, round(tokens / rounds / max(RUN, 100 * tokens**0.5)))  # shards of a round
    rows = docs.select(F.xxhash64("doc_id", "text").alias("row"), "text").mapInArrow(encoder(vocabulary, each * rounds), "shard int, place long, piece int, tokens binary, n long")
    turn = F.when(F.col("shard") >= 0, F.col("shard") % rounds).otherwise(-1)
    coded, drop = stored(rows.withColumn("turn", turn), "turn")
    codes = coded.where("turn = -1").groupBy("place").agg(F.sum("n").alias("n")).toPandas()  # a row for each code at most
    table = spelling(codes["place"].to_numpy(np.int64), codes["n"].to_numpy(np.int64))
    common = start(vocabulary)
    size = len(common["vectors"]) + sum(x.size for x in common.values())

    def add(a: bytes, b: bytes) -> bytes:
        return (np.frombuffer(a, np.int64) + np.frombuffer(b, np.int64)).tobytes() if a and b else a or b

    for turn, rate in enumerate(RATES):
        held = context.broadcast((common, vocabulary))

        def learn(parts: Iterator[pa.RecordBatch], held=held, rate=rate) -> Iterator[pa.RecordBatch]:
            weights, known = held.value
            shard, now, total = None, None, None
            for batch in parts:
                for own, raw in zip(batch.column("shard").to_pylist(), batch.column("tokens"), strict=True):
                    if own != now:
                        total = shard.moved() + (0 if total is None else total) if shard else None
                        shard, now = Shard(weights, known, rate), own
                    shard.read(np.frombuffer(raw.as_buffer(), known.kind))
            if shard:
                total = shard.moved() + (0 if total is None else total)
                yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["moved"])

        dealt = coded.where(F.col("turn") == turn).withColumn("part", F.floor(F.col("shard") / rounds).cast("int")).repartitionById(each, F.col("part"))
        moves = dealt.sortWithinPartitions("shard", "place", "piece").select("shard", "tokens").mapInArrow(learn, "moved binary")
        total = moves.rdd.map(lambda r: bytes(r.moved)).treeAggregate(b"", add, add, depth=2)
        held.unpersist()
        if total:
            common = averaged(common, np.frombuffer(total, np.int64))
        assert not total or len(total) == 8 * size
    drop()
    return common, table


def log_likelihoods(texts: list[np.ndarray], w: dict[str, np.ndarray], vocabulary: Vocabulary, chunk: int = BATCH) -> np.ndarray:
    """Sum of log p(id | both sides) for each text, in whole units.

    All chunks have one shape, and doubles are multiplied: products of floats differ in their last bits by the place in a chunk, which
    can turn a unit. So a token's value doesn't depend on what is read with it.
    """
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum():
        return np.zeros(len(texts), np.int64)
    line, at = windows(texts)
    units = np.empty(-(-len(at) // chunk) * chunk, np.int64)
    some = np.full(len(units), at[-1])
    some[: len(at)] = at
    within, w = vocabulary.within, {k: x.astype(np.float64) for k, x in w.items()}
    for s in range(0, len(units), chunk):
        places = some[s : s + chunk]
        own = line[places]
        _, _, mass, total = forward(w, line[places[:, None] + OFFSETS])
        logs = np.log(mass[vocabulary.classes[own], np.arange(chunk)] / total) + within[own]
        units[s : s + chunk] = np.round(logs * UNIT)
    total = np.concatenate([[0], np.cumsum(units[: len(at)])])
    ends = np.cumsum(sizes)
    return total[ends] - total[ends - sizes]


def scored(batch: pa.RecordBatch, w: dict[str, np.ndarray], vocabulary: Vocabulary, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and log-likelihood of each text of a batch."""
    sizes, units = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
    texts: list[list[np.ndarray]] = [[] for _ in range(batch.num_rows)]
    last = np.round(vocabulary.last * UNIT).astype(np.int64)
    for words in split(*bytes_of(batch)):
        ids, rare = vocabulary.encode(words.hashes)
        line = np.zeros(len(words.raw) + 1, np.int64)
        np.cumsum(table[spelled(words.raw, words.starts, words.ends)], out=line[1:])
        own = np.zeros(len(ids) + 1, np.int64)
        own[rare + 1] = line[words.ends[rare]] - line[words.starts[rare]] + last[words.raw[words.ends[rare] - 1]]
        own, ends = np.cumsum(own), np.cumsum(words.counts)
        here = slice(words.first, words.first + len(ends))
        units[here] += own[ends] - own[ends - words.counts]
        sizes[here] += words.counts
        for i, (a, b) in enumerate(zip((ends - words.counts).tolist(), ends.tolist(), strict=True)):
            texts[words.first + i].append(ids[a:b])
    whole = [t[0] if len(t) == 1 else np.concatenate(t) if t else np.empty(0, vocabulary.kind) for t in texts]
    if whole:
        units += log_likelihoods(whole, w, vocabulary)
    return sizes, units / UNIT


def score(docs: DataFrame, words: int | None = None) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, mean`` for each row of ``docs``: the masked pseudo-likelihood of its whole text.

    Words are counted over all texts and the network learns from all of them, in one pass. ``words`` (or the square
    root of the tokens) have ids of their own; the rest are predicted by their last byte's shape and spelled backwards. A null
    or empty text has no tokens: its sum and its mean are 0. Equal texts have equal scores, whatever rows they are
    in, and scores don't depend on the order of rows or on partitions. Ties and repeated rows each keep their row; other
    columns are not looked at. An empty table gives an empty result. A text of any length is read in pieces.
    """
    batches(docs.sparkSession)
    vocabulary, tokens = vocabulary_of(docs, words)
    weights, table = train(docs, vocabulary, tokens)
    held = docs.sparkSession.sparkContext.broadcast((weights, vocabulary, table))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts:
            sizes, sums = scored(batch, *held.value)
            total = sums.round(4)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(total), pa.array(total / np.maximum(sizes, 1))], ["doc_id", "n_tokens", "log_likelihood", "mean"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens long, log_likelihood double, mean double")
