"""SimHash components, repeated strings and sketches against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from foliant.llm import components, near_copies, repeats, simhash, sketch

DOCS = "doc_id long, text string, fp string, key string, spans string"


def words_of(text):
    return re.findall("[^\x20\x09-\x0d]+", text or "")


def roots(n, pairs):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 340)] + [(7, 7), (1, 0), (-5, 399)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = roots(401, [(a + 1 if a >= 0 else 0, b + 1) for a, b in edges if a != b])
    index = lambda x: x + 1 if x >= 0 else 0
    back = lambda i: i - 1 if i else -5
    for node, root in got.items():
        assert root == back(want[index(node)])
    assert set(got) == {x for e in edges if e[0] != e[1] for x in e}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_fingerprint():
    for text in ("", "one", "One two", "A b c", "Ä b\u00a0c d\x0be F g " * 7, "x y z " * 50):
        words = [w.encode().lower().decode() for w in words_of(text)]
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
        counts = [sum(xxhash.xxh64_intdigest(s.encode(), 42) >> b & 1 for s in shingles) for b in range(64)]
        assert simhash.fingerprint(text.encode()) == sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


@pytest.mark.parametrize("limit", [simhash.LIST_LIMIT, 3])
def test_links_keep_every_component(spark, limit):
    rng = random.Random(7)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for f in fps[:20]:
        for _ in range(6):
            g = f
            for b in rng.sample(range(64), rng.randint(1, 4)):
                g ^= 1 << b
            fps.append(g)
    fps = sorted(set(fps) | {0, (1 << 64) - 1, 7, 1 << 63})
    signed = [f - (1 << 64 if f >> 63 else 0) for f in fps]
    place = {s: i for i, s in enumerate(signed)}
    got = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long"), limit).collect()
    near = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]
    assert {(max(place[r.a], place[r.b]), min(place[r.a], place[r.b])) for r in got} <= set(near)
    assert roots(len(fps), [(place[r.a], place[r.b]) for r in got]) == roots(len(fps), near)


def test_near_duplicates(spark):
    base = " ".join(f"word{i}" for i in range(400))
    rows = [(9, base), (4, base), (4, base), (7, base + " more"), (2, ""), (3, None), (1, "other text here"), (None, base), (None, "alone and null here")]
    got = simhash.near_duplicates(spark.createDataFrame([(*r, "x", "y", None) for r in rows], DOCS)).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert [len(by[i]) for i in (4, 9, 2, None)] == [2, 1, 1, 2]
    assert {r.component_id for r in by[9] + by[4]} == {4} and by[3][0].component_id == 2 and by[2][0].fingerprint == "0" * 16
    assert {r.component_id for r in by[None]} == {4, None}
    docs = spark.createDataFrame([(*r, "x", "y", None) for r in rows], DOCS)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    kept = sorted(str(r.doc_id) for r in near_copies.one_of_each(docs).collect())
    assert kept == ["1", "2", "4", "None"]


def shingled(text):
    words = [w.encode().lower() for w in words_of(text)]
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near_texts(rng):
    """Texts, and copies of them in which some words are replaced, left out or moved, from very alike to hardly."""
    out = []
    for _ in range(25):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(3, 300))]
        out.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            own = list(words)
            for _ in range(rng.randint(0, max(1, len(own) // 25))):
                at = rng.randrange(len(own))
                own[at : at + 1] = rng.choice([[], ["new"], [own[at], "more"]])
            out.append("  ".join(w.upper() if rng.random() < 0.2 else w for w in own))
    return out


@pytest.mark.parametrize("limit", [near_copies.LIST_LIMIT, 3])
def test_one_of_each(spark, limit):
    rng = random.Random(12)
    texts = near_texts(rng)
    rows = [(i, t, None, "x", str(i)) for i, t in enumerate(texts)] + [(0, texts[0], None, "x", "0"), (5000, "", "a", "b", "c"), (5001, None, "a", "b", "c"), (None, "alone " * 9, "a", "b", "c"), (None, "another " * 9, "a", "b", "c"), (7, "with the id of another", "a", "b", "c")]
    docs = spark.createDataFrame(rows, DOCS)
    sets = [shingled(r[1]) for r in rows]
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    assert len(pairs) > 40
    group = roots(len(rows), pairs)
    best = {}
    for i, r in enumerate(rows):
        rank = (r[0] is None, r[0], i)
        best[group[i]] = min(best.get(group[i], rank), rank)
    got = near_copies.one_of_each(docs, limit=limit).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in got) == sorted((b[0], b[1] or 0) for b in best.values())
    assert {r.text for r in got} <= {r[1] for r in rows}


def test_one_of_each_keeps_unlike_rows_and_columns(spark):
    rows = [(None, "one text of its own here"), (None, "quite another text stands there"), (7, "third text that is unlike"), (7, "a fourth one that shares the id"), (8, "A Fourth one that shares the id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("_kept", "key", "row", "id", "place", "a.b")})
    got = near_copies.one_of_each(docs)
    assert got.columns == docs.columns and got.count() == 4
    assert all(r["_kept"] == "_kept" and r["a.b"] == "a.b" for r in got.collect())
    assert near_copies.one_of_each(docs.limit(0)).count() == 0


def test_a_large_group_of_near_copies(spark):
    rng = random.Random(13)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(600):
        own = list(words)
        for at in rng.sample(range(400), 4):
            own[at] = f"v{rng.randrange(9)}"
        texts.append(" ".join(own))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.doc_id for r in near_copies.one_of_each(docs, limit=50).collect()] == [0]


def cut(texts, size=repeats.LENGTH):
    seen = {}
    for t in texts:
        for i in range(len(t) - size + 1):
            seen[t[i : i + size]] = seen.get(t[i : i + size], 0) + 1
    out = []
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - size + 1):
            if seen[t[i : i + size]] > 1:
                gone[i : i + size] = b"\1" * size
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def sample_texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 9)))
    some = lambda n: " ".join(word() for _ in range(n))
    passage, line = some(70), some(31)
    texts = [some(rng.randint(1, 300)) for _ in range(25)] + [some(20) + passage + some(20) for _ in range(8)] + [passage[3:-5] + some(9), passage, passage, line * 9, "ab" * 400, "a" * 900]
    texts += [texts[0], texts[3][:-7] + "Z" + texts[3][-6:], texts[5][50:] + texts[6][:300], "", "x" * 199, "x" * 199, "y" * 200, "y" * 201, "\0" * 450]
    texts += [passage[:99] + some(3) + passage[i:] for i in range(90, 130, 5)]
    return texts


def test_longest_factors():
    rng = random.Random(8)
    for _ in range(300):
        text = [rng.choice("ab") for _ in range(rng.randint(1, 14))]
        n = len(text)
        order = sorted(range(n), key=lambda i: text[i:])
        share = lambda i, j: next((k for k in range(n - max(i, j)) if text[i + k] != text[j + k]), n - max(i, j))
        lcp = np.array([0] + [share(a, b) for a, b in zip(order, order[1:], strict=False)])
        at = np.array(order)
        previous = [max((share(i, j) for j in range(i)), default=0) for i in order]
        following = [max((share(i, j) for j in range(i + 1, n)), default=0) for i in order]
        assert repeats.longest_factors(at, lcp).tolist() == previous
        assert repeats.longest_factors(-at, lcp).tolist() == following
        assert (repeats.longest_factors(at, lcp, 3) >= 3).tolist() == [x >= 3 for x in previous]


def grouped(rng):
    """Surroundings of anchors in groups, as factors() takes them, cut from near copies."""
    base, rows = bytes(rng.choice(b"abc") for _ in range(336)), []
    for g in range(rng.randint(1, 6)):
        for _ in range(rng.randint(1, 9)):
            own = bytearray(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4])):
                own[rng.choice([rng.randrange(136), rng.randrange(200, 336)])] = rng.choice(b"xyz")
            low, high = rng.choice([0, 0, rng.randrange(136)]), rng.choice([336, 336, rng.randrange(201, 336)])
            rows.append((g, 136 - low, bytes(own[low:high])))
    return rows


@pytest.mark.parametrize("first", [False, True])
def test_factors_of_groups(monkeypatch, first):
    rng = random.Random(9)

    def run(rows):
        size = np.array([len(r[2]) for r in rows])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        left = np.array([r[1] for r in rows])
        return repeats.factors(np.array([r[0] for r in rows]), left, np.frombuffer(b"".join(r[2] for r in rows), np.uint8), begin + left, size, first)

    differ = 0
    for _ in range(60):
        rows = grouped(rng)
        want = np.zeros((len(rows), repeats.REACH + 1), bool)
        for i, (g, left, raw) in enumerate(rows):
            for back in range(left + 1):
                string = raw[left - back : left - back + 200]
                others = [r for j, r in enumerate(rows) if j != i and r[0] == g and r[1] >= back and (j < i or not first)]
                want[i, back] = len(string) == 200 and any(r[2][r[1] - back : r[1] - back + 200] == string for r in others)
        assert np.array_equal(run(rows), want)
        with monkeypatch.context() as wrong:  # the arrays decide
            wrong.setattr(repeats, "longest_factors", lambda position, lcp, enough=0: np.maximum(lcp - 1, 0))
            differ += not np.array_equal(run(rows), want)
    assert differ > 30


def test_first_copies_stay(spark):
    texts = sample_texts()
    rows = [(i, t, "x", "y", None) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, DOCS)
    for limit in (repeats.GROUP_LIMIT, 2):
        got = {r.doc_id: r for r in repeats.remove_repeats(docs, limit, first=True).collect()}
        place = {r.doc_id: r.k for r in docs.selectExpr("doc_id", "xxhash64(doc_id, text) as k").collect()}
        seen, gone = set(), {}
        for i in sorted(place, key=place.get):
            raw = (texts[i] or "").encode()
            gone[i] = bytearray(len(raw))
            for at in range(len(raw) - 199):
                if raw[at : at + 200] in seen:
                    gone[i][at : at + 200] = b"\1" * 200
                seen.add(raw[at : at + 200])
        for i, flags in gone.items():
            assert got[i].kept == bytes(c for c, g in zip((texts[i] or "").encode(), flags, strict=True) if not g), i


@pytest.mark.parametrize("limit", [repeats.GROUP_LIMIT, 2])
def test_repeats(spark, limit):
    texts = sample_texts()
    rows = [(i, t, "x", "clash", None) for i, t in enumerate(texts)] + [(len(texts), None, None, None, None), (0, texts[0], None, None, None)]
    got = repeats.remove_repeats(spark.createDataFrame(rows, DOCS), limit).collect()
    want = cut([(r[1] or "").encode() for r in rows])
    assert len(got) == len(rows)
    for r in got:
        spans = r.spans
        assert (r.n_bytes, sum(s["to"] - s["from"] for s in spans), len(spans), hashlib.sha256(bytes(r.kept)).hexdigest()) == want[r.doc_id]
    assert repeats.remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_anchors_do_not_depend_on_pieces(monkeypatch):
    text = "".join(sample_texts()).encode()
    whole = repeats.anchors(text)
    monkeypatch.setattr(repeats, "PIECE", 700)
    assert np.array_equal(whole, repeats.anchors(text))
    for start in range(0, len(text) - repeats.LENGTH, 53):
        inside = whole[(whole >= start) & (whole <= start + repeats.REACH)]
        assert len(inside)
        assert set(repeats.anchors(text[start : start + repeats.LENGTH]) + start) <= set(inside)


def shingles(text):
    w = words_of(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_sketch_estimates():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    x, y = sketch.sketch(a.encode()), sketch.sketch(b.encode())
    A, B = shingles(a), shingles(b)
    assert sketch.resemblance(x, y) == pytest.approx(len(A & B) / len(A | B), abs=0.15)
    assert sketch.containment(x, y) == pytest.approx(len(A & B) / len(A), abs=0.2)
    assert sketch.count(x) == pytest.approx(len(A), rel=0.3)
    assert np.array_equal(sketch.from_text(sketch.to_text(x)), x)
    parts = sketch.merge(sketch.sketch(" ".join(words[:2000]).encode()), sketch.sketch(" ".join(words[1996:4000]).encode()))
    assert np.array_equal(parts, x)
    empty = sketch.sketch(b"")
    assert sketch.resemblance(empty, empty) == 1.0 and sketch.resemblance(empty, x) == 0.0 and sketch.containment(empty, x) == 1.0


@pytest.mark.parametrize("parts", [1, 5])
def test_edited_texts(spark, parts):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["été", "alpha", "b", "gamma😀"]) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", None, "one"]
    rows = [(i * 3, t, "x", "y", "z") for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in sketch.with_edits(spark.createDataFrame(rows, DOCS).repartition(parts)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    for i, row in enumerate(order):
        text, nxt = row[1] or "", order[(i + 1) % len(order)][1] or ""
        changed = text[: len(text) - len(text) // 3] + nxt[: len(text) // 3]
        r = got[row[0]]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        for value, other in ((r.near_edited, changed), (r.near_next, nxt)):
            A, B = shingles(text), shingles(other)
            assert value == pytest.approx(len(A & B) / len(A | B) if A | B else 1.0)  # exact under K shingles


def test_edited_texts_of_few_rows(spark):
    assert sketch.with_edits(spark.createDataFrame([], DOCS)).count() == 0
    one = sketch.with_edits(spark.createDataFrame([(None, "a b c d e f", None, None, None)], DOCS)).collect()
    assert one[0].near_next == 1.0 and one[0].doc_id is None
    rows = [(5, "same text", None, None, None)] * 3 + [(5, "another", None, None, None), (None, None, None, None, None)]
    got = sketch.with_edits(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(str(r.doc_id) for r in got) == ["5", "5", "5", "5", "None"]
    assert len({r.fingerprint for r in got}) == 3


def test_sketch_of_long_texts_is_merged_from_parts():
    rng = random.Random(14)
    for n in (0, 1, 4, 5, 6, 63, 64, 65, 68, 69, 500):
        text = " ".join(f"w{rng.randrange(300)}" for _ in range(n)).encode()
        assert np.array_equal(sketch.sketch(text, 20, 64), sketch.sketch(text, 20))


def test_one_id_with_many_rows_is_cut(spark):
    rows = [(7, f"text {i}") for i in range(400)] + [(None, f"other {i}") for i in range(400)] + [(i, "x") for i in range(1000, 1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    placed = docs.select(F.coalesce("doc_id", F.lit(sketch.LEAST)).alias("place"), F.xxhash64("text").alias("tie"))
    bounds = sketch.cuts(placed, 8)
    counts = [r["count"] for r in placed.groupBy(sketch.part_of(F.struct("place", "tie"), bounds).alias("part")).count().collect()]
    assert len(counts) > 5 and max(counts) < 260
    ordered = placed.select("place", "tie", sketch.part_of(F.struct("place", "tie"), bounds).alias("part")).collect()
    ordered.sort(key=lambda r: (r.place, r.tie), reverse=True)
    assert [r.part for r in ordered] == sorted(r.part for r in ordered)
    got = sketch.with_edits(docs).collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    assert len(got) == len(rows) and {r.edited_sha256 for r in got if r.doc_id == 1000} == {hashlib.sha256(b"x").hexdigest()} and order


def test_simhash_joins_stay_off_the_driver(spark):
    """Only the table of flipped bits is broadcast: tables that grow with the input would fill the driver."""
    rows = spark.range(50).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words and then "), F.col("id")).alias("text"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    joins = re.findall(r"BroadcastHashJoin \[(\w+)#", plan(simhash.links(simhash.fingerprints(rows).select("fp").distinct(), 3)))
    assert set(joins) == {"quad"}
    assert "BroadcastHashJoin" not in plan(simhash.near_duplicates(rows))
