"""URL rules as a sort-merge range join over reversed-host keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import lower_ascii

#: (host, path, verdict)
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
#: A list of rules goes to every executor up to so many rows; longer lists take the label join below.
BROADCAST_RULES = 200_000


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://``, A-Z lower-cased) and path (up to ``?``, ``#`` or the end); empty for null or no ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    tail = F.substring(rest, F.length(host) + 1, F.length(rest))
    return lower_ascii(host), F.regexp_extract(tail, r"(?s)^[^?#]*", 0)


def host_key(host: str) -> str:
    """Labels in reverse, each closed by U+0001, so that a host's key is a prefix of its subdomains' keys."""
    return "\x01".join(host.split(".")[::-1]) + "\x01"


def sweep(rules: list[tuple[str, str, str]]):
    """A function over batches sorted by key: advances through the rules' intervals, keeping those open on a stack.

    A rule's host opens an interval of keys that begin with its own key; intervals nest or are apart. Of the
    rules on the stack, those whose path starts the url's path fit, and the longest of them decides. A host's paths are
    looked up by the lengths they have, longest first.
    """
    paths: dict[str, dict[str, tuple[str, str]]] = {}
    for host, path, verdict in sorted(rules, reverse=True):
        paths.setdefault(host_key(host), {})[path] = (host + path, verdict)
    keys = sorted(paths)
    sides = {k: (own, sorted({len(p) for p in own}, reverse=True)) for k, own in paths.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[str] = []
        at, seen = 0, ""
        for batch in batches:
            got, verdicts = [], []
            for key, path in zip(batch.column("key").to_pylist(), batch.column("path").to_pylist(), strict=True):
                if key < seen:  # a batch of another sorted run
                    stack, at = [], 0
                seen = key
                while stack and not key.startswith(stack[-1]):
                    stack.pop()
                while at < len(keys) and keys[at] <= key:
                    if key.startswith(keys[at]):
                        stack.append(keys[at])
                    at += 1
                best = None
                for k in stack:
                    own, lengths = sides[k]
                    found = next((own[path[:n]] for n in lengths if path[:n] in own), None)
                    if found and (best is None or (len(found[0]), found[0]) > (len(best[0]), best[0])):
                        best = found
                got.append(best and best[0])
                verdicts.append(best and best[1])
            kept = [batch.column(n) for n in batch.schema.names if n not in ("key", "salt")]
            names = [n for n in batch.schema.names if n not in ("key", "salt")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(got, pa.string()), pa.array(verdicts, pa.string())], [*names, "rule", "verdict"])

    return run


def by_labels(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for a list of rules of any length: hosts meet rules on each of their suffixes.

    Both sides are dealt by suffix; of a url's rules only the longest is carried on.
    """
    labels = F.split("host", r"\.")
    suffix = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    keyed = urls.withColumn("row", F.monotonically_increasing_id())
    met = keyed.select("row", "path", F.explode(suffix).alias("rule_host")).join(rules, "rule_host")
    met = met.where(F.col("path").startswith(F.col("rule_path"))).withColumn("name", F.concat("rule_host", "rule_path"))
    best = met.groupBy("row").agg(F.max(F.struct(F.length("name").alias("n"), "name", "rule_verdict")).alias("best"))
    return keyed.join(best, "row", "left").drop("row").select(
        *urls.columns, F.col("best.name").alias("rule"), F.col("best.rule_verdict").alias("verdict")
    )


def judge(pages: DataFrame, rules=RULES, otherwise: str = "allow") -> DataFrame:
    """``page_id, host, path, rule, verdict`` for each row of ``pages``.

    A null url, or one without ``://``, has an empty host and path, fits no rule and gets ``otherwise``.
    Repeated rows are judged one by one. An empty table gives an empty result. Rows are spread by range of
    (key, salt), so that one host, or one url, with many rows is split over tasks.
    """
    host, path = host_and_path(F.col("url"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    rules = list(rules)
    if len(rules) > BROADCAST_RULES:
        given = pages.sparkSession.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
        out = by_labels(urls, given)
    else:
        key = F.concat(F.array_join(F.reverse(F.split("host", r"\.")), "\x01"), F.lit("\x01"))
        keyed = urls.withColumn("key", key).withColumn("salt", F.xxhash64("page_id", "path"))
        ordered = keyed.repartitionByRange("key", "salt").sortWithinPartitions("key")
        page = pages.schema["page_id"].dataType.simpleString()
        out = ordered.mapInArrow(sweep(rules), f"page_id {page}, host string, path string, rule string, verdict string")
    return out.withColumn("verdict", F.coalesce("verdict", F.lit(otherwise)))
