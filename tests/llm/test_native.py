"""Mixing, personal data and URL rules against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from foliant.llm import mixing, pii, urls

DOCS = "doc_id long, text string, source string, lang string, size string"


def water(sizes, weights=(5, 2, 1), share=1.5, epochs=2):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > epochs * sizes[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = float(epochs * sizes[s])
            left -= target[s]
        open_ -= full
    return target


def test_mixing(spark, monkeypatch):
    rows = [(i, " ".join(["w"] * (i % 17)), ["b", "a", None, "é", "z"][i * i % 5], "en", "x") for i in range(300)]
    rows += [(1, None, "a", None, "x"), (None, "one two", "a", None, "x"), (1, "w", "only", None, None), (400, "", "empty", None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix(docs).collect()
    sizes = {}
    for r in rows:
        sizes[r[2]] = sizes.get(r[2], 0) + len((r[1] or "").split())
    want = water(sizes)
    taken = {}
    assert len(got) == len(rows) and all(0 <= r.times <= 2 for r in got)
    for r in got:
        taken[r.row.source] = taken.get(r.row.source, 0) + len((r.row.text or "").split()) * r.times
    for s, t in want.items():
        assert abs(taken[s] - t) <= 17
    again = mixing.mix(spark.createDataFrame(rows[::-1], DOCS)).collect()
    key = lambda r: (r.row.doc_id is None, r.row.doc_id, r.row.text or "", r.times)
    assert sorted(map(key, got)) == sorted(map(key, again))
    told = mixing.digest(docs).collect()
    assert sorted((r.doc_id or -1, r["size"], r.taken) for r in told) == sorted((r.row.doc_id or -1, n := len((r.row.text or "").split()), n * r.times) for r in got)
    assert all(r.source_size in sizes.values() and any(r.target == pytest.approx(t) for t in want.values()) for r in told)
    for digits in ((1,), (3, 31), (4,)):  # whatever the slices
        monkeypatch.setattr(mixing, "DIGITS", digits)
        assert sorted(map(key, mixing.mix(docs).collect())) == sorted(map(key, got))


def test_mixing_of_nothing_and_clashing_names(spark):
    assert mixing.mix(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame([(i, "a b", "s", "x", 7) for i in range(5)], "doc_id long, text string, source string, size string, `of` int")
    docs = docs.withColumns({"row": F.lit(1), "draw": F.lit("d"), "times": F.lit(9), "a.b": F.lit(0)})
    got = mixing.mix(docs).collect()
    assert len(got) == 5 and all((r.row["size"], r.row["of"], r.row["row"], r.row["draw"], r.row["times"], r.row["a.b"]) == ("x", 7, 1, "d", 9, 0) for r in got)


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(s))) % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}
PRIVATE = [
    "", None, "é😀 a@b.co, x.y+z@m-1.example.org.", "a@b.co_c@d.com@e.fr", "@@a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 0255.01.1.9 99999999999999999999.1.1.1",
    "card 4539 1488 0343 6467 and 4539148803436468 4539-1488-0343-6467-1", "+1 (988) 555-2485 +12 3 +49 (0) 30.1234567 +1                 ", "+44 20 7946 0958+44 20 7946 0959",
    "4111111111111111.2.3.4", "IBAN GB82 WEST 1234 5698 7654 32 bank", "GB82WEST12345698765433", "x" * 50_000 + "@" + "a." * 20_000, "1." * 20_000, "1 " * 5_000, "+1" + " " * 9_000,
    " ".join(f"u{i}@h{i}.example.com" for i in range(300)), "social security 123-45-6789, 000-12-3456", "a\n@b.c\t127.0.0.1",
]


def test_personal_data(spark):
    rows = [(i, t, "s", "l", None) for i, t in enumerate(PRIVATE)] + [(3, PRIVATE[3], None, None, None)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, DOCS)).collect()}
    for i, text in enumerate(PRIVATE):
        spans = sorted((m.start(), k, m.end(), name) for k, (name, (pattern, ok)) in enumerate(BASE.items()) for m in re.finditer(pattern, text or "") if ok(m[0]))
        want = ",".join(f"{name}:{a}:{b}" for a, _, b, name in spans)
        assert got[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), (i, want, got[i].spans)
        assert [got[i][f"n_{k}"] for k in BASE] == [sum(s[3] == k for s in spans) for k in BASE]
        if not got[i].n_added:
            assert got[i].spans == want
    assert got[10].spans.endswith("iban:5:32") and got[11].n_added == 0
    assert got[17].spans == "ssn:16:27" and got[17].n_email == 0


def test_redaction(spark):
    rows = [(1, "mail a@b.co now +1 (988) 555-2485", "s", "l", None), (2, None, "s", "l", None), (3, "clean", None, None, None)]
    got = pii.redact(spark.createDataFrame(rows, DOCS).withColumn("n_chars", F.length("text"))).collect()
    assert [r.text for r in got] == ["mail [EMAIL] now [PHONE]", None, "clean"]
    assert [r.n_chars for r in got] == [24, None, 5]


def iban(country, tail):
    value = int("".join(str(int(c, 36)) for c in tail + country + "00")) % 97
    return f"{country}{98 - value:02d}{tail}"


def test_ibans_end_where_their_country_says(spark):
    rng = random.Random(31)
    good = [iban(c, "".join(rng.choice("0123456789ABCXYZ") for _ in range(n - 4))) for n, own in pii.IBAN_LENGTHS.items() for c in own.split()]
    texts = ["account " + " ".join(g[i : i + 4] for i in range(0, len(g), 4)) + rng.choice([" BANK", " 12 PAY", ".", "", " x"]) for g in good]
    texts += ["account " + g + "A" for g in good[:20]] + ["account " + g[:-1] for g in good[:20]] + ["account " + g[:4] + ("1" if g[4] != "1" else "2") + g[5:] for g in good[:20]] + ["account ZZ" + g[2:] for g in good[:5]]
    rows = [(i, t, None, None, None) for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in pii.digest(spark.createDataFrame(rows, DOCS)).collect()}
    for i, g in enumerate(good):
        assert f"iban:8:{8 + len(g) + (len(g) - 1) // 4}" in got[i].spans.split(","), texts[i]
    assert not any("iban" in got[i].spans for i in range(len(good), len(texts)))


def test_redaction_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a@b.co"), (2, None)], "doc_id int, text string").withColumns({c: F.lit(c) for c in ("row", "found", "merged", "changed", "_pii", "found_email", "n.m")})
    got = {r.doc_id: r for r in pii.redact(docs).collect()}
    assert got[1].text == "[EMAIL]" and got[2].text is None
    assert all(r[c] == c for r in got.values() for c in docs.columns[2:])
    assert pii.redact(docs.limit(0)).columns == docs.columns and pii.redact(docs.limit(0)).count() == 0 and pii.digest(docs.limit(0)).count() == 0


URLS = [
    None, "", "no scheme", "http://example.org", "http://example.org/", "https://WWW.Example.ORG/es/x?y#z", "https://notexample.org/es/1", "http://a.b.example.org/en/12/3", "http://x.com/fr/1", "http://com/fr/",
    "http://x.com/FR/", "ftp://x.com:80/fr/", "http://x.com/de/?a://b/c", "x://y://z/w", "http://É.org/ä?", "http://example.org/es", "http://example.org?/es/", "http://m.com/de/\n/x", "http:///fr/",
]


def judged(url):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        host, path = re.sub("[A-Z]", lambda m: m[0].lower(), raw), re.match(r"[^?#]*", rest[len(raw) :])[0]
    fit = [(len(h + p), h + p, v) for h, p, v in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, None, "allow"))
    return host, path, best[1], best[2]


@pytest.mark.parametrize("limit", [urls.BROADCAST_RULES, 1])
def test_url_rules(spark, monkeypatch, limit):
    monkeypatch.setattr(urls, "BROADCAST_RULES", limit)
    given = URLS + URLS[5:9] * 30
    pages = spark.createDataFrame([(i, u, "<html>", "clash") for i, u in enumerate(given)], "page_id long, url string, html string, host string")
    got = urls.judge(pages).collect()
    assert len(got) == len(given)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == judged(given[r.page_id]), given[r.page_id]
    assert urls.judge(pages.limit(0)).count() == 0


def test_sweep_with_many_nested_rules(spark):
    rules = [(h, p, "block") for h in ("a", "b.a", "c.b.a", "x.a", "ba", "b-a.a") for p in ("/", "/p/", "/p/q")]
    given = [f"http://{h}{p}" for h in ("a", "z.a", "b.a", "d.c.b.a", "ba", "x.ba", "b-a.a", "bb.a", "c") for p in ("", "/", "/p", "/p/", "/p/qq")]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    for r in urls.judge(pages, rules).collect():
        fit = [(len(h + p), h + p) for h, p, _ in rules if (r.host == h or r.host.endswith("." + h)) and r.path.startswith(p)]
        assert r.rule == max(fit, default=(0, None))[1]
        assert r.verdict == ("block" if fit else "allow")
