"""Language models, latent retrieval, license alignment and the pipeline against brute force and held-out text."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from foliant.llm import common, kneser_ney, latent, licenses, masked_lm, mixing, pii, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long, nats string"


def grammar(rng, n):
    """Sentences in which a word tells much of the next one."""
    out, w = [], 0
    for _ in range(n):
        w = (w * 3 + rng.choice([1, 2])) % 23
        out.append(f"w{w}")
    return " ".join(out)


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash") for i, t, lang in rows], DOCS)


def test_masked_lm_learns_order(spark):
    rng = random.Random(1)
    rows = [(i, grammar(rng, 120), "en") for i in range(300)]
    shuffled = [(i + 1000, " ".join(rng.sample(t.split(), 120)), "en") for i, t, _ in rows[:40]]
    rows += [*shuffled, (2000, None, None), (2001, "", None), (2002, "unseen-word " * 3, None), (None, rows[0][1], None), (0, rows[0][1], None)]
    got = masked_lm.score(frame(spark, rows).repartition(3)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    better = [by[i].mean > by[i + 1000].mean for i in range(40)]
    assert np.mean(better) > 0.9
    assert by[2000].log_likelihood == 0 and by[2001].n_tokens == 0 and by[2002].n_tokens == 3
    assert by[None].log_likelihood == by[0].log_likelihood
    assert masked_lm.score(frame(spark, []).limit(0)).count() == 0


def some_vocabulary(rng):
    words = np.array([rng.randrange(1 << 63) for _ in range(200)], np.uint64)
    return masked_lm.Vocabulary(words, np.arange(400, 200, -1), np.arange(256) % 7)


def test_masked_lm_probabilities_sum_to_one():
    v = some_vocabulary(random.Random(2))
    _, _, mass, total = masked_lm.forward(masked_lm.start(v), np.array([[5, 80, 0, 7], [70, 3, 0, 0]]))
    ids = np.arange(1, v.size)
    assert ((mass / total)[v.classes[ids]] * np.exp(v.within[ids])[:, None]).sum(0) == pytest.approx([1, 1], abs=1e-3)
    for own in range(1, masked_lm.SHAPES + 1):  # the last byte within its shape
        assert np.exp(v.last[masked_lm.shape(np.arange(256)) == own]).sum() == pytest.approx(1)
    table = masked_lm.spelling(np.arange(0, 5000, 3), np.arange(1667) % 9)
    assert np.exp(table.reshape(-1, 256) / masked_lm.UNIT).sum(1) == pytest.approx(np.ones(masked_lm.CONTEXTS), abs=1e-3)


def test_masked_lm_by_brute_force():
    rng = random.Random(21)
    texts = [None, "", " \t ", "one", "a b c d e f", "Zürich ist schön, 12 mal", " ".join(rng.choice(["the", "of", "xyz", "q"]) for _ in range(9000))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    known = tokens.words_of(0, np.frombuffer(b"the of", np.uint8), np.array([0, 6])).hashes
    v = masked_lm.Vocabulary(known, np.array([9, 5]), np.ones(256, np.int64))
    w = masked_lm.start(v)
    table = masked_lm.spelling(np.arange(0, 9000, 2), np.arange(4500) % 11)
    sizes, sums = masked_lm.scored(batch, w, v, table)
    place = {b"the": int(v.ids[v.keys == known[0]][0]), b"of": int(v.ids[v.keys == known[1]][0])}
    for text, n, total in zip(texts, sizes, sums, strict=True):
        words = (text or "").encode().split()
        assert n == len(words)
        ids = [place.get(x) or (x[-1] & 63) + 1 for x in words]
        want = 0.0
        for i, word in enumerate(words):
            x = np.concatenate([w["vectors"][ids[i + o] if 0 <= i + o < n else 0] for o in (-2, -1, 1, 2)]).astype(float)
            logits = w["out"].astype(float) @ np.tanh(x @ w["mix"] + w["bias"]) + w["prior"]
            want += logits[v.classes[ids[i]]] - np.log(np.exp(logits).sum()) + v.within[ids[i]]
            if word not in place:
                want += v.last[word[-1]]
                for j in range(len(word)):
                    context = masked_lm.BYTE_CLASS[word[j]] * 33 + (masked_lm.BYTE_CLASS[word[j + 1]] if j + 1 < len(word) else 32)
                    want += table[context * 256 + (word[j - 1] if j else 32)] / masked_lm.UNIT
        assert total == pytest.approx(want, abs=0.02)


def test_words_of_texts_in_pieces():
    rng = random.Random(22)
    texts = ["", " ", "ab cd"] + ["".join(rng.choice("ab \n\x85é") for _ in range(rng.randint(0, 90))) for _ in range(60)] + ["x" * 300 + " y", "long " * 100]
    raw, offsets = tokens.bytes_of(pa.RecordBatch.from_arrays([pa.array([*texts, None])], ["text"]).slice(1))
    of = {}
    for piece in (1, 7, 64, 1 << 18):
        found = [[] for _ in range(len(texts))]
        for words in tokens.split(raw, offsets, piece):
            at = 0
            for i, n in enumerate(words.counts.tolist()):
                for a, b, h in zip(words.starts[at : at + n].tolist(), words.ends[at : at + n].tolist(), words.hashes[at : at + n].tolist(), strict=True):
                    found[words.first + i].append(words.raw[a:b].tobytes())
                    assert of.setdefault(found[words.first + i][-1], h) == h and h & 255 == found[words.first + i][-1][-1]
                at += n
        assert found == [t.encode().split() for t in texts[1:]] + [[]]
    assert len(set(of.values())) == len(of)


def test_masked_lm_whatever_the_layout(spark):
    rng = random.Random(23)
    rows = [(i // 2 if i < 40 else i, grammar(rng, rng.randint(0, 200)), "en") for i in range(400)]
    rows += [rows[3]] * 20 + [(None, None, None), (None, rows[5][1], None)]
    first = sorted(map(str, masked_lm.score(frame(spark, rows).repartition(1)).collect()))
    rng.shuffle(rows)
    assert sorted(map(str, masked_lm.score(frame(spark, rows).repartition(7)).collect())) == first


def test_kneser_ney_is_a_distribution():
    rng = random.Random(2)
    words = [kneser_ney.START.encode(), kneser_ney.END.encode()] + [f"w{i}".encode() for i in range(12)]
    counts = {}
    for _ in range(60):
        line = [0, 0] + [rng.randrange(2, 14) for _ in range(rng.randint(0, 9))] + [1]
        for t in zip(line, line[1:], line[2:], strict=False):
            counts[t] = counts.get(t, 0) + 1
    model = kneser_ney.fit(words, np.array(list(counts)), np.array(list(counts.values())))
    scorer = kneser_ney.Scorer(model)
    for context in ((0, 0), (0, 5), (3, 4), (14, 3), (14, 14), (1, 1)):
        p = [np.exp(-scorer.tokens(np.array([*context, c]))[0]) for c in range(15)]
        assert sum(p) == pytest.approx(1.0), context
    again = kneser_ney.unpacked(kneser_ney.packed(model))
    assert again.words == words and (again.keys3 == model.keys3).all() and np.allclose(again.own3, model.own3)
    texts = [" ".join(f"w{rng.randrange(15)}" for _ in range(rng.randint(0, 50))) for _ in range(30)] + ["", None]
    line = tokens.bytes_of(pa.RecordBatch.from_arrays([pa.array(texts)], ["text"]))
    whole, small = scorer.score(*line), scorer.score(*line, 7)
    assert np.allclose(whole[0], small[0]) and (whole[1] == small[1]).all()
    for text, nats, n in zip(texts, *whole, strict=True):
        ids = [0, 0] + [words.index(w.encode()) if w.encode() in words else 14 for w in (text or "").split()] + [1]
        assert n == len(ids) - 2 and nats == pytest.approx(sum(scorer.tokens(np.array(ids[i : i + 3]))[0] for i in range(n)))


def test_quality_by_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, grammar(rng, rng.randint(20, 60)), "en" if i % 2 else None) for i in range(300)]
    bad = [(1000 + i, " ".join(f"w{rng.randrange(23)}" for _ in range(40)), "en") for i in range(60)]
    rows += [*bad, (2000, None, "xx"), (2001, "", "en"), (None, rows[1][1], "en"), (1, rows[1][1], "en")]
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(0, 300)] + [(1000 + i, 0, 0) for i in range(0, 60, 2)] + [(None, 1, 0), (7, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(docs, labels, 150).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert np.mean([by[i].keep for i in range(300)]) >= 0.97
    assert np.mean([not by[1000 + i].keep for i in range(60)]) > 0.9
    ids = {r.doc_id for r in kneser_ney.chosen(labels, 150).collect()}
    for lang in ("en", None):
        held = sorted(round(by[i].nats, 2) for i in range(300) if i not in ids and (i % 2 == 1) == (lang == "en"))
        want = next(v for k, v in enumerate(held, 1) if k >= 0.99 * len(held))
        assert next(r.threshold for r in got if r.lang == lang and r.doc_id is not None and r.doc_id < 300) == pytest.approx(np.exp(want))
    kept = kneser_ney.keep_good(docs, labels, 150)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.keep)
    nothing = kneser_ney.classify(docs, labels.where("quality = 5"))
    assert nothing.where("keep").count() == len(rows) and nothing.where("nats is null").count() == len(rows)
    assert kneser_ney.classify(docs.limit(0), labels).count() == 0


def test_quality_is_fitted_on_all_trusted_documents(spark, monkeypatch):
    rng = random.Random(27)
    rows = [(i, grammar(rng, rng.randint(0, 9)), "en") for i in range(5000)] + [(6000 + i, f"w{i} unseen words", "en") for i in range(20)] + [(7000, None, "en"), (7001, "", "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(5000)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows).repartition(3)
    ids = {r.doc_id for r in kneser_ney.chosen(labels).collect()}
    assert len(ids) > 3500 and ids == {r.id for r in spark.range(5000).where("pmod(xxhash64(id), 4) <> 0").collect()}
    lines = [["\x01", "\x01", *text.split(), "\x02"] for i, text, _ in rows if i in ids]
    words = sorted({w for line in lines for w in line})
    place, counts = {w: i for i, w in enumerate(words)}, {}
    for line in lines:
        for t in zip(line, line[1:], line[2:], strict=False):
            t = tuple(place[w] for w in t)
            counts[t] = counts.get(t, 0) + 1
    grams = sorted(counts)
    scorer = kneser_ney.Scorer(kneser_ney.fit([w.encode() for w in words], np.array(grams), np.array([counts[t] for t in grams])))
    sums, sizes = scorer.score(*tokens.bytes_of(pa.RecordBatch.from_arrays([pa.array([text for _, text, _ in rows])], ["text"])))
    want = {i: x for (i, _, _), x in zip(rows, sums / sizes, strict=True)}
    for shard, chunk in ((1 << 20, 1 << 20), (3000, 700)):  # one shard and many
        monkeypatch.setattr(kneser_ney, "SHARD", shard)
        monkeypatch.setattr(kneser_ney, "CHUNK", chunk)
        got = {r.doc_id: r.nats for r in kneser_ney.classify(docs, labels).collect()}
        assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-4


def test_quality_holds_few_bytes_a_word(spark, monkeypatch):
    """A task that scores holds under 60 bytes for each word of its chunk, whatever it does with them."""
    rng = random.Random(28)
    docs = frame(spark, [(i, grammar(rng, 1000), "en") for i in range(50)])
    model, runs = kneser_ney.train(docs, docs.select("doc_id")), []
    batch = pa.RecordBatch.from_arrays([pa.array([grammar(rng, 1000) for _ in range(20)])], ["text"])
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    kneser_ney.scores(docs.select("text"), model)
    tracemalloc.start()
    got = [x for b in runs[0](iter([batch] * 50)) for x in b.column("nats").to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == 1000 and got[:20] * 50 == got and peak < 60 * 1_000_000


def test_toxic_text_is_not_trusted(spark):
    rng = random.Random(18)
    rows = [(i, grammar(rng, 40), "en") for i in range(400)]
    rows += [(1000 + i, " ".join(f"w{rng.randrange(23)}" for _ in range(40)), "en") for i in range(50)]
    labels = [(i, 1, 0 if i % 2 else None) for i in range(400)] + [(1000 + i, 1, 1) for i in range(50)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert {r.doc_id for r in kneser_ney.chosen(labels).collect()} <= set(range(400))
    got = {r.doc_id: r.keep for r in kneser_ney.classify(frame(spark, rows), labels, 150).collect()}
    assert np.mean([got[i] for i in range(400)]) >= 0.97 and np.mean([not got[1000 + i] for i in range(50)]) > 0.9


def test_lcs():
    rng = random.Random(4)
    for _ in range(100):
        a, b = ([rng.choice([b"a", b"b", b"c", b"d"]) for _ in range(rng.randint(1, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert latent.lcs(latent.masks_of(a), len(a), b) == table[-1][-1]


def test_leaks(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["the", "of", "and"] * 20 + [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "lm", "x", "p", "t", "ck")]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(rng.randint(15, 70)) for _ in range(30)]
    rows, want = [], {}
    for i in range(200):
        words = some(rng.randint(5, 400))
        if i % 4 == 0:
            item, kind = rng.randrange(30), i // 4 % 3
            passage = list(items[item])
            if kind == 1:  # a tenth of the words replaced
                for j in rng.sample(range(len(passage)), len(passage) // 10):
                    passage[j] = "changed"
            if kind == 2:  # some left out, some put in
                passage = [w for j, w in enumerate(passage) if j % 9] + ["more"]
                passage.insert(len(passage) // 2, "inside")
            at = rng.randrange(len(words) + 1)
            words[at:at] = [w.upper() + "," if rng.random() < 0.1 else w for w in passage]
            want[i] = item
        rows.append((i, " ".join(words), "en"))
    rows += [(900, None, "en"), (901, "", "en"), (902, "word " * 40_000 + " ".join(items[3]), "en"), (903, "Nd, " * 500, None), (None, " ".join(items[4]), None), (0, rows[0][1], None)]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, None), (98, " ,. ")], "item_id long, text string")
    docs = frame(spark, rows)
    got = latent.leaks(docs, benchmark).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    brute = set()
    for i, text, _ in rows:
        words = latent.plain((text or "").encode())
        for k, item in enumerate(items):
            masks, n = latent.masks_of([w.encode() for w in item]), len(item)
            if any(latent.lcs(masks, n, words[s : s + n + n // 2]) >= 0.8 * n for s in range(0, max(1, len(words) - n // 2), max(1, n // 4))):
                brute.add((i, k))
    assert {(i, k) for i, k in want.items()} <= brute | found
    assert len(brute & found) >= 0.95 * len(brute) and (902, 3) in found and (None, 4) in found
    assert all(k in (98, 99) or i is None or i >= 900 or want.get(i) == k for i, k in found)
    clean = latent.without_leaks(docs, benchmark)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == sorted(str(i) for i, _, _ in rows if i not in {f[0] for f in found})
    assert latent.leaks(docs, benchmark.limit(0)).count() == 0 and latent.leaks(docs.limit(0), benchmark).count() == 0
    monkeypatch.setattr(latent, "BENCHMARK_BYTES", 2000)
    assert {(r.doc_id, r.item_id) for r in latent.leaks(docs, benchmark).collect()} == found


def test_leak_beside_heavier_windows(spark):
    rng = random.Random(15)
    item = [f"q{i}" for i in range(40)]
    noise = [f"z{i}" for i in range(400)]
    shuffled = [rng.sample(item, 40) for _ in range(6)]  # as heavy as the copy, or heavier, but out of order
    heavy = [w for w in item[:20] for _ in range(1)] * 4
    true = [w if j % 5 else "changed" for j, w in enumerate(item)]
    rows = [(0, " ".join([w for s in shuffled[:3] for w in s] + true + [w for s in shuffled[3:] for w in s]), "en"), (1, " ".join(true + heavy[::-1]), "en")]
    rows += [(2, " ".join(w for s in shuffled for w in s), "en")] + [(10 + i, " ".join(rng.sample(noise, 60)), "en") for i in range(60)]
    benchmark = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(noise[:30]))], "item_id long, text string")
    assert {r.doc_id for r in latent.leaks(frame(spark, rows), benchmark).collect() if r.item_id == 0} == {0, 1}


def test_leak_in_many_documents(spark):
    rng = random.Random(16)
    hot, rare, noise = [f"h{i}" for i in range(30)], [f"r{i}" for i in range(30)], [f"z{i}" for i in range(500)]
    some = lambda n: [rng.choice(noise) for _ in range(n)]
    edited = [w if j % 6 else "changed" for j, w in enumerate(hot)]
    rows = [(i, " ".join(some(40) + ([], hot, edited)[i % 3] + some(20) + (rare if i == 9 else [])), "en") for i in range(90)]
    benchmark = spark.createDataFrame([(0, " ".join(hot)), (1, " ".join(rare))], "item_id long, text string")
    want = {(i, 0) for i in range(90) if i % 3} | {(9, 1)}
    assert {(r.doc_id, r.item_id) for r in latent.leaks(frame(spark, rows), benchmark).collect()} == want
    everywhere = [(i, f"{' '.join(some(30) + hot)}", "en") for i in range(20)]
    assert latent.without_leaks(frame(spark, everywhere), benchmark).count() == 0


def test_leaks_of_more_items_than_dimensions(spark, monkeypatch):
    rng = random.Random(17)
    vocabulary = [f"{a}{b}{c}" for a in "bdfgkmnt" for b in "aeiou" for c in "nrstlmxpbckdfg"]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [some(35) for _ in range(300)]
    edited = [[w if j % 4 else "changed" for j, w in enumerate(item)] for item in items]
    apart = [[w if j % 10 not in (2, 5, 8) else "changed" for j, w in enumerate(item)] for item in items]  # few runs of three
    rows = [(i, " ".join(some(rng.randint(5, 90)) + (items, edited, apart)[i % 3][i] + some(30)), "en") for i in range(300)]
    rows += [(1000 + i, " ".join(some(120)), "en") for i in range(100)] + [(2000, "yes", "en"), (2001, "such words elsewhere", "en")]
    benchmark = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(500, "yes")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent.leaks(frame(spark, rows), benchmark, rank=8).collect()}
    assert got == {(i, i) for i in range(300)} | {(2000, 500)}
    monkeypatch.setattr(latent, "PART_ITEMS", 100)
    assert {(r.doc_id, r.item_id) for r in latent.leaks(frame(spark, rows), benchmark, rank=8).collect()} == got


def test_randomised_decomposition_spans_the_items(spark):
    rng = random.Random(6)
    terms = sorted(f"t{i:03d}".encode() for i in range(80))
    rows = [(i, " ".join(rng.choice(terms).decode() for _ in range(64)), "en") for i in range(80)]
    weights = np.ones(len(terms))
    items = [np.array(rng.sample(range(80), 12)) for _ in range(10)]
    space = latent.latent_space(frame(spark, rows), 80, items, terms, weights, rank=40)
    assert space.shape == (80, 40) and np.allclose(space.T @ space, np.eye(40), atol=1e-3)
    vectors = np.zeros((80, 10))
    for j, own in enumerate(items):
        vectors[own, j] = 1
    held = np.linalg.norm(space.T @ vectors, axis=0) / np.linalg.norm(vectors, axis=0)
    assert held.min() > 0.8


def test_space_is_fitted_on_all_documents(spark):
    rng = random.Random(26)
    terms = sorted(f"t{i:03d}".encode() for i in range(60))
    rows = [(i, " ".join(rng.choice(terms + [b"other", b"T007,t008"]).decode() for _ in range(rng.randint(0, 90))), "en") for i in range(300)] + [(None, None, "en"), (300, "t001 t001 t001", "en")]
    weights = np.array([rng.choice([0.0, 0.5, 2.0]) for _ in terms])
    items = [np.array([j for j in rng.sample(range(60), 12) if weights[j]]) for _ in range(5)]
    docs = frame(spark, rows).repartition(3)
    index = {t: i for i, t in enumerate(terms) if weights[i] > 0}
    gram, count = np.zeros((60, 60)), 0
    for _, text, _ in rows:
        ids = np.array([index.get(w, -1) for w in latent.plain((text or "").encode())], np.int64)
        ids[1:][ids[1:] == ids[:-1]] = -1
        for at in range(0, len(ids), latent.PASSAGE):
            row = np.bincount(own := ids[at : at + latent.PASSAGE][ids[at : at + latent.PASSAGE] >= 0], minlength=60) * weights
            if len(own):
                gram += np.outer(row, row) / (weights[own] ** 2).sum()
                count += 1
    for own in items:
        row = np.bincount(own, minlength=60) * weights
        gram += count / len(items) * np.outer(row, row) / (weights[own] ** 2).sum()
    best = np.linalg.eigh(gram)[1][:, -12:]
    for n_docs, most in ((301, 4096), (301, 0), (10**6, 4096)):  # however many documents there are, and by either way of adding up
        space = latent.latent_space(docs, n_docs, items, terms, weights, rank=60, most=most)[:, :12]
        assert np.allclose(space @ space.T, best @ best.T, atol=1e-3)
    got, n = latent.document_frequencies(docs, terms)
    assert n == len(rows) and got.tolist() == [sum(t in latent.plain((x or "").encode()) for _, x, _ in rows) for t in terms]


def test_rising():
    rng = random.Random(7)
    for _ in range(100):
        places = rng.sample(range(30), rng.randint(0, 10))
        got = licenses.rising(places)
        best = [1] * len(places)
        for i in range(len(places)):
            best[i] = 1 + max((best[j] for j in range(i) if places[j] < places[i]), default=0)
        assert len(got) == max(best, default=0) and all(places[a] < places[b] and a < b for a, b in zip(got, got[1:], strict=False))


def test_alignment_is_a_common_subsequence():
    rng = random.Random(8)
    for _ in range(100):
        a, b = ([rng.choice("abcdefghij") for _ in range(rng.randint(0, 20))] for _ in range(2))
        pairs = licenses.aligned(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    assert licenses.aligned(list("abcxd"), list("abcyd")) == [(0, 0), (1, 1), (2, 2), (4, 4)]


def test_license_coverage_by_brute_force(spark):
    """Where a template's words stand in one passage only, its coverage is the longest common subsequence with the whole text."""
    rng = random.Random(25)
    templates = [(f"T{k}", "text", " ".join(f"t{k}w{i}" for i in range(n))) for k, n in enumerate((5, 12, 40, 90))]
    other, rows, want = [f"o{i}" for i in range(300)], [], {}
    for d in range(120):
        name, _, text = templates[d % 4]
        passage = [w for w in text.split() if rng.random() > d / 400]
        for _ in range(rng.randint(0, len(passage) // 6)):
            passage.insert(rng.randrange(len(passage) + 1), rng.choice(other))
        if rng.random() < 0.3 and len(passage) > 4:
            at = rng.randrange(len(passage) - 2)
            passage[at], passage[at + 1] = passage[at + 1], passage[at]
        words = [rng.choice(other) for _ in range(rng.randint(0, 200))]
        at = rng.randrange(len(words) + 1)
        words[at:at] = passage
        own = text.split()
        row = [0] * (len(words) + 1)
        for x in own:
            before, row = row, [0] * (len(words) + 1)
            for j, y in enumerate(words):
                row[j + 1] = before[j] + 1 if x == y else max(row[j], before[j + 1])
        rows.append((d, " ".join(words), None))
        if row[-1] >= 0.8 * len(own):
            want[d, name] = round(row[-1] / len(own), 4)
    got = {(r.doc_id, r.license): r.coverage for r in licenses.licenses(frame(spark, rows), templates).collect()}
    assert got == want and 30 < len(want) < 115


def test_licenses(spark):
    mit = next(t for n, f, t in licenses.TEMPLATES if n == "MIT" and f == "text")
    words = mit.split()
    del words[10:14]
    rows = [
        (1, "some text\n" + mit + "\nmore " * 50, None), (2, "x " * 400 + " ".join(words).lower() + " tail", None), (3, "Released under the MIT License.\n" * 2, None), (4, "the the of and license under mit", None),
        (5, None, None), (6, "", None), (7, "Licensed under CC BY-NC 4.0.\nReleased under the MIT License.", None), (8, "This work is licensed under the GNU General Public License, version 3.", None), (None, "Licensed under CC BY-NC 4.0.", None),
    ]
    got = {(r.doc_id, r.license, r.form) for r in licenses.licenses(frame(spark, rows)).collect()}
    assert got == {(1, "MIT", "text"), (2, "MIT", "text"), (3, "MIT", "notice"), (7, "CC-BY-NC-4.0", "notice"), (7, "MIT", "notice"), (8, "GPL-3.0", "notice"), (None, "CC-BY-NC-4.0", "notice")}
    assert licenses.licenses(frame(spark, rows).limit(0)).count() == 0


def test_licenses_beside_similar_ones(spark):
    by = {f"{n} {f}": t for n, f, t in licenses.TEMPLATES}
    gpl2 = by["GPL-2.0 notice"].replace("This work", "That work")
    rows = [
        (1, by["CC-BY-NC-4.0 notice"] + " x" * 30 + " " + by["CC-BY-4.0 notice"], None), (2, by["CC-BY-NC-4.0 notice"] + " " + by["CC-BY-4.0 notice"], None),
        (3, by["GPL-3.0 notice"] + " x" * 20 + " " + gpl2, None), (4, by["Apache-2.0 header"] + " x" * 50 + " " + by["Apache-2.0 notice"], None),
        (5, (by["CC-BY-NC-4.0 notice"] + " x" * 9 + " ") * 4, None), (6, by["Apache-2.0 header"], None),
    ]
    got = {(r.doc_id, r.license, r.form) for r in licenses.licenses(frame(spark, rows)).collect()}
    want = {(i, n, "notice") for i in (1, 2) for n in ("CC-BY-NC-4.0", "CC-BY-4.0")} | {(3, "GPL-3.0", "notice"), (3, "GPL-2.0", "notice")}
    assert got == want | {(4, "Apache-2.0", "header"), (4, "Apache-2.0", "notice"), (5, "CC-BY-NC-4.0", "notice"), (6, "Apache-2.0", "header")}


@pytest.fixture(scope="session")
def corpus(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(9)
    vocabulary = [a + b + c for a in "bdfgk" for b in "aeiou" for c in ("n", "r", "st", "lm", "p", "t")]
    some = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = some(30)
    texts = [some(rng.randint(30, 120)) for _ in range(120)]
    texts += [texts[0], texts[1] + " tail", item, some(40) + " " + item, some(20) + " mail a@b.co", some(20) + " zz%% " * 60, None, ""]
    rows = [(i, t, "en", f"s{i % 3}", len(t) if t is not None else None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 120)] + [(125, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, texts, item


def test_pipeline_stages(spark, corpus, tmp_path):
    folder, texts, item = corpus
    docs = common.table(spark, folder, "documents")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(str(tmp_path / name))
        seen[name] = docs, (docs := spark.read.parquet(str(tmp_path / name)))
    before, after = seen["quality"]
    judged = kneser_ney.classify(before, common.table(spark, folder, "labels")).where("keep")
    assert sorted(r.doc_id for r in after.collect()) == sorted(r.doc_id for r in judged.collect()) and 125 not in {r.doc_id for r in after.collect()}
    assert len({r.doc_id for r in after.collect()} & set(range(120))) >= 114
    before, after = seen["near_duplicates"]
    sets = {}
    for r in before.collect():
        words = (r.text or "").lower().split()
        sets[r.doc_id] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    first = {i: min(j for j in sets if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])) for i in sets}
    assert {r.doc_id for r in after.collect()} == {i for i in sets if first[i] == i}
    before, after = seen["decontamination"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in before.collect() if item not in (r.text or "")}
    before, after = seen["personal_data"]
    assert {r.doc_id: r.text for r in after.collect()} == {r.doc_id: r.text and r.text.replace("a@b.co", "[EMAIL]") for r in before.collect()}
    before, after = seen["mix"]
    want = {r.row.doc_id: r.times for r in mixing.mix(before).where("times > 0").collect()}
    got = {r.doc_id: r.n for r in after.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert got == want
    assert pii.detect(before).where(F.size("found") > 0).count() == 0


def test_quality_without_a_limit_keeps_all(spark):
    ids = [r.id for r in spark.range(100).where("pmod(xxhash64(id), 4) <> 0").collect()]
    docs = frame(spark, [(i, f"w{i} some words here", "en") for i in ids[:20]]).withColumns({"nats": F.lit(1), "limit": F.lit(2), "keep": F.lit(3), "row": F.lit(4), "of": F.lit(5)})
    labels = spark.createDataFrame([(i, 1, 0) for i in ids[:3]], "doc_id long, quality int, toxic int")  # all of them in the model, none left to judge by
    ids_used = sorted(r.doc_id for r in kneser_ney.chosen(labels).collect())
    assert ids_used == ids[:3]
    assert kneser_ney.classify(docs, labels).where("keep").count() == 20
    kept = kneser_ney.keep_good(docs, labels)
    assert kept.count() == 20 and kept.columns == docs.columns
    assert all((r["nats"], r["limit"], r["keep"], r["row"], r["of"]) == (1, 2, 3, 4, 5) for r in kept.collect())


def test_pipeline_of_nothing_and_of_clashing_names(spark, corpus):
    folder, _, _ = corpus
    docs = common.table(spark, folder, "documents")
    names = ("size", "copy", "_mix", "_kept", "_nats", "_pii", "_limit", "row", "key", "id", "times", "found", "limit", "of")
    wide = docs.withColumns({c: F.lit(c) for c in names})
    for stage_name, stage in corpus_pipeline.STAGES:
        few = stage(spark, wide.where("doc_id < 30"), folder)
        rows = few.limit(3).collect()
        assert rows and all(r[c] == c for r in rows for c in names if c != "copy"), stage_name
        assert stage(spark, wide.limit(0), folder).count() == 0, stage_name


def test_pipeline_runs_as_a_whole(spark, corpus):
    folder, texts, item = corpus
    got = corpus_pipeline.run(spark, folder).collect()
    assert got and len({r.doc_id for r in got}) > 60
    assert not any(item in (r.text or "") for r in got)


def test_large_benchmarks_go_in_parts(spark):
    rng = random.Random(24)
    items = [(i, " ".join(f"t{rng.randrange(40_000)}" for _ in range(400))) for i in range(2500)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    docs = frame(spark, [(i, "before " + items[i * 7][1] + " after", "en") for i in range(6)] + [(100, "nothing of all that", "en")])
    parts = latent.prepared(docs, benchmark, 100, 16)
    assert len(parts) >= 3 and sum(len(p[2]) for p in parts) == 2500
    assert max(len(p[0]) * len(p[2]) for p in parts) <= 2 * latent.PART_CELLS
    assert {(r.doc_id, r.item_id) for r in latent.leaks(docs, benchmark, 100, 16).collect()} == {(i, i * 7) for i in range(6)}


def test_pipeline_fits_on_all_documents(spark, corpus, monkeypatch):
    """Neither fit of the pipeline gets a bound on its documents."""
    folder, _, _ = corpus
    asked, space, train = [], latent.latent_space, kneser_ney.train
    monkeypatch.setattr(latent, "latent_space", lambda *a: asked.append(a[5]) or space(*a))
    monkeypatch.setattr(kneser_ney, "train", lambda docs, ids: asked.append(ids.count()) or train(docs, ids))
    docs = common.table(spark, folder, "documents")
    corpus_pipeline.decontamination(spark, docs, folder)
    corpus_pipeline.quality(spark, docs, folder)
    labels = common.table(spark, folder, "labels")
    assert asked == [None, kneser_ney.trusted_ids(labels).where("pmod(xxhash64(doc_id), 4) <> 0").count()]


def test_table_of_terms_is_held_once_and_by_half():
    rng, n = np.random.default_rng(31), 900
    ids, at = rng.integers(0, n, 40_000), np.sort(rng.integers(0, 3000, 40_000))
    weights, x = rng.random(n) + 0.1, rng.normal(size=(n, 5))
    tracemalloc.start()
    table = np.zeros(n * (n + 1) // 2)
    for first, last in latent.pieces(at):
        latent.products(table, ids[first:last], at[first:last], weights)
    tracemalloc.reset_peak()
    got = weights[:, None] * latent.multiplied(table, weights[:, None] * x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    rows = np.zeros((3000, n))
    np.add.at(rows, (at, ids), weights[ids])
    length = np.sqrt(np.bincount(at, weights[ids] ** 2, 3000))
    rows /= np.where(length > 0, length, 1)[:, None]
    assert np.allclose(got, rows.T @ (rows @ x))
    assert most < n * n * 8  # a whole table and its mirror image took more than twice that


def test_executors_give_heap_back_before_the_fit(spark, monkeypatch):
    context, order = spark.sparkContext, []
    context.setJobGroup("release", "")
    common.release(spark)
    jobs = context.statusTracker().getJobIdsForGroup("release")
    context.setLocalProperty("spark.jobGroup.id", None)
    assert [context.statusTracker().getStageInfo(s).numTasks for j in jobs for s in context.statusTracker().getJobInfo(j).stageIds] == [context.defaultParallelism]
    space = latent.latent_space
    monkeypatch.setattr(latent, "release", lambda spark: order.append("release"))
    monkeypatch.setattr(latent, "latent_space", lambda *args: order.append("fit") or space(*args))
    benchmark = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30)))], "item_id long, text string")
    latent.prepared(frame(spark, [(i, f"word{i} and word{i + 1}", "en") for i in range(20)]), benchmark, None, 8)
    assert order == ["release", "fit"]


def test_a_score_does_not_depend_on_its_place():
    rng = np.random.default_rng(3)
    v = masked_lm.Vocabulary(np.sort(rng.integers(0, 1 << 62, 3000).astype(np.uint64)), np.arange(3000, 0, -1), np.arange(256) % 7)
    w = {k: x if k == "prior" else x * np.float32(8) for k, x in masked_lm.start(v).items()}
    texts = [rng.integers(1, v.size, rng.integers(1, 200)).astype(v.kind) for _ in range(200)]
    together = masked_lm.log_likelihoods(texts, w, v).tolist()
    assert masked_lm.log_likelihoods(texts[::-1], w, v)[::-1].tolist() == together
    assert [int(masked_lm.log_likelihoods([t], w, v)[0]) for t in texts[:50]] == together[:50]
