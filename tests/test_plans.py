"""The facade, the streams, the catalogue search, and the driver's contract."""

import random
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from foliant import catalog
from foliant.functions import text
from foliant.operators import search
from foliant.plans import jobs
from foliant.streaming import files


def test_jobs(spark):
    pages = spark.createDataFrame([("d", i) for i in range(1, 6)], "source string, page_no int")
    assert jobs.run("split-every", pages, n=2).agg(F.max("part")).first()[0] == 2
    with pytest.raises(ValueError):
        jobs.run("nothing", pages)
    with pytest.raises(NotImplementedError):
        jobs.run("office", pages)
    again = jobs.with_repair("split-every", pages, "page_no < 3", lambda rest: rest.withColumn("page_no", F.col("page_no") - 2), n=2)
    assert again.count() == 5


def test_search(spark):
    rows = [(0, "Merge PDF", "join combine", "organize"), (1, "Word to PDF", "docx convert", "convert"), (2, "PDF to Word", "docx convert", "convert"), (3, "Compress PDF", "shrink", "optimize")]
    tools = spark.createDataFrame(rows, "pos int, label string, keywords string, category string")
    names = lambda q: [r.label for r in search.search(tools, q).collect()]
    assert names("merge pdf")[0] == "Merge PDF" and names("combin") == ["Merge PDF"]
    assert names("comprses") == ["Compress PDF"] and names("docx to pdf")[0] == "Word to PDF"
    assert names("please") == [r[1] for r in rows] and names("qqqqqq") == []
    assert names("pdf to word")[0] == "PDF to Word" and "Word to PDF" not in names("pdf to docx") and names("PDF to jpeg") == []
    rng = random.Random(5)
    pairs = [("".join(rng.choice("abc") for _ in range(rng.randint(1, 9))), "".join(rng.choice("abc") for _ in range(rng.randint(1, 9)))) for _ in range(400)]
    pairs += [(a, a[:i] + a[i + 1 : i + 2] + a[i : i + 1] + a[i + 2 :] + rng.choice(["", "x"])) for a, _ in pairs for i in (0, 2)]
    for asked in {a for a, _ in pairs[:60]}:
        words = spark.createDataFrame([(b,) for _, b in pairs] + [(b,) for a, b in pairs if a == asked], "w string")
        for r in words.select("w", search.edits(asked, F.col("w")).alias("n"), search.cost(asked, F.col("w")).alias("c")).collect():
            true, most = text.osa(asked, r.w), 2 if len(asked) >= 7 else 1 if len(asked) >= 4 else 0
            assert r.n == true or (r.n > 2 and true > 2), (asked, r.w)
            want = 0 if asked == r.w else 0.12 if r.w.startswith(asked) else 0.25 if len(asked) >= 3 and asked in r.w else 0.6 + 0.15 * true if true <= most else None
            assert r.c == (want if want is None else pytest.approx(want)), (asked, r.w)


def test_streams(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"one {i}\ntwo") for i in range(6)], "doc_id long, text string")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = files.paragraphs(files.documents(spark, str(tmp_path / "in"), docs.schema, 1))
    query = stream.writeStream.format("memory").queryName("pars").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("pars").count() == 12
    events = spark.createDataFrame([(i // 2, f"2024-01-01 00:{i:02d}:00", "a") for i in range(20)], "event_id long, ts string, event_type string").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    events.write.parquet(str(tmp_path / "events"))
    for name, made, mode in (("rates", files.rates, "complete"), ("once", files.once_each, "append")):
        query = made(files.documents(spark, str(tmp_path / "events"), events.schema)).writeStream.format("memory").outputMode(mode).queryName(name).start()
        query.processAllAvailable()
        query.stop()
    assert spark.table("rates").agg(F.sum("n")).first()[0] == 20 and spark.table("once").count() == 10


def test_contract():
    names, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(names) and set(catalog.queries()) <= set(names)
    assert not any(re.search(r"\blimit\b", s) for s in sql.values())
