"""Order-aware aggregates: upper medians, modes, thresholds, colours, rates, votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_value(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Counts of values with running counts: what order statistics need, in rows that grow with the distinct values only."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    run = Window.partitionBy(*keys).orderBy(value)
    return counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(Window.partitionBy(*keys))})


def order_statistic(df: DataFrame, keys: list[str], value: str, place: Column, name: str) -> DataFrame:
    """The value at ``place`` (from 0, in terms of ``all``) of the sorted values of each key."""
    return by_value(df, keys, value).where(F.col("upto") > place).groupBy(*keys).agg(F.min(value).alias(name))


def upper_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The middle value, of an even number the upper one of the middle two."""
    return order_statistic(df, keys, value, F.floor(F.col("all") / 2), "median")


def percentile(df: DataFrame, keys: list[str], value: str, parts: int, at: int) -> DataFrame:
    """The value at ``at`` of ``parts`` parts of the sorted values, exact."""
    return order_statistic(df, keys, value, F.floor(F.col("all") * at / parts), "percentile")


def mode(df: DataFrame, keys: list[str], value: str, order: str, weight: str | None = None) -> DataFrame:
    """The value with most rows (or weight) for each key; of equals the one that reached it first, that is whose last row comes first."""
    amount = F.sum(weight) if weight else F.count("*")
    counts = df.groupBy(*keys, value).agg(amount.alias("amount"), F.max(order).alias("last"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("amount", -F.col("last"))).alias("mode"), F.max("amount").alias("amount"))


def vote(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """The value with most rows for each key; of equals the one seen first."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("first"))
    return counts.groupBy(*keys).agg(F.max_by(value, F.struct("votes", -F.col("first"))).alias("winner"), F.max("votes").alias("votes"))


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.coalesce(F.max(value) - F.min(value), F.lit(0)).alias("spread"))


def otsu(df: DataFrame, keys: list[str], value: str, bins: int = 128) -> DataFrame:
    """``bin``: the first bin after which a cut parts the values (from 0 to 1) with the largest variance between both sides."""
    place = F.least(F.floor(F.col(value) * bins), F.lit(bins - 1))
    counts = df.withColumn("bin", place.cast("int")).groupBy(*keys, "bin").agg(F.count("*").alias("n"))
    low, all_ = Window.partitionBy(*keys).orderBy("bin"), Window.partitionBy(*keys)
    counts = counts.withColumns({
        "n_low": F.sum("n").over(low), "s_low": F.sum(F.col("n") * F.col("bin")).over(low), "n_all": F.sum("n").over(all_), "s_all": F.sum(F.col("n") * F.col("bin")).over(all_),
    })
    high = F.col("n_all") - F.col("n_low")
    apart = F.col("s_low") / F.col("n_low") - F.try_divide(F.col("s_all") - F.col("s_low"), high)
    between = F.coalesce(F.col("n_low") * high * apart * apart, F.lit(0.0))
    return counts.groupBy(*keys).agg(F.max_by("bin", F.struct(F.round(between, 6), -F.col("bin"))).alias("bin"))


def common_color(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """``red, green, blue``: the mean of the pixels in the fullest of the buckets of five bits a channel (of equals the least bucket)."""
    bucket = F.shiftleft(F.shiftright("r", 3), 10) + F.shiftleft(F.shiftright("g", 3), 5) + F.shiftright("b", 3)
    sums = pixels.withColumn("bucket", bucket).groupBy(*keys, "bucket").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in "rgb"])
    best = sums.groupBy(*keys).agg(F.max_by(F.struct("m_r", "m_g", "m_b", "n"), F.struct("n", -F.col("bucket"))).alias("c"))
    return best.select(*keys, *[F.round(F.col(f"c.m_{c}"), 4).alias(name) for c, name in (("r", "red"), ("g", "green"), ("b", "blue"))], F.col("c.n").alias("n"))


def generation_rate(events: DataFrame, keys: list[str], ts: str = "ts") -> DataFrame:
    """``tokens, per_second``: a key's events after the first by the time since the first; null for one moment."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    per = events.groupBy(*keys).agg(F.count("*").alias("tokens"), micros(F.min(ts)).alias("a"), micros(F.max(ts)).alias("b"))
    return per.select(*keys, "tokens", F.round((F.col("tokens") - 1) * 1e6 / F.nullif(F.col("b") - F.col("a"), F.lit(0)), 9).alias("per_second"))


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: files that are added again are dropped."""
    rank = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(rank)).where("_n = 1").drop("_n")


def list_ordinals(items: DataFrame) -> DataFrame:
    """``list_id, pos, ordinal``: numbers of list items, where ``value`` sets one and ``step`` (1 or -1) goes on from it; ``start`` is the first."""
    order = Window.partitionBy("list_id").orderBy("pos")
    anchor = F.sum(F.when(F.col("value").isNotNull(), 1).otherwise(0)).over(order)
    held = items.withColumn("stretch", anchor)
    inside = Window.partitionBy("list_id", "stretch").orderBy("pos")
    base = F.coalesce(F.first("value").over(inside), F.col("start"))
    return held.select("list_id", "pos", (base + F.col("step") * (F.row_number().over(inside) - 1)).cast("int").alias("ordinal"))
