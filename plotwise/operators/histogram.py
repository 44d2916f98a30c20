"""Adaptive histograms: equal bins, or bins equal in the logarithm with one for small values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Metric:
    name: str
    bins: int
    floor: float = 0.0  # values up to it share a bin on a logarithmic scale
    log: bool | None = None  # None: where the values spread widely
    money: bool = False
    whole: bool = False


#: Bins and floors of the published metrics: fixed values.
CATALOGUE = (
    Metric("value_land", 24, 10_000.0, money=True),
    Metric("value_bldg", 24, 10_000.0, money=True),
    Metric("units", 18, 2.5, log=True, whole=True),
    Metric("year_built", 24, log=False, whole=True),
    Metric("portfolio_units", 18, 2.5, log=True, whole=True),
    Metric("portfolio_value", 24, 100_000.0, money=True),
)
WIDE, TINY, ENOUGH = 25.0, 1e-6, 20


def histogram(values: DataFrame, metrics=CATALOGUE) -> DataFrame:
    """From (metric, value): a row for each bin with its edges and count, and the metric's suggested range.

    One pass takes extremes and percentiles, the second counts; the last bin holds its upper edge.
    """
    spark = values.sparkSession
    spec = spark.createDataFrame([(m.name, m.bins, m.floor, m.log, m.money, m.whole) for m in metrics], "metric string, bins int, floor double, log boolean, money boolean, whole boolean")
    known = values.where("value is not null and not isnan(value)")
    stats = known.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.min(F.when(F.col("value") > 0, F.col("value"))).alias("positive"),
        F.percentile("value", F.array(F.lit(0.05), F.lit(0.95))).alias("p"),
    )
    stats = stats.join(F.broadcast(spec), "metric")  # a row for each metric
    may = F.col("positive").isNotNull() & (F.col("high") > F.col("positive"))
    wide = ~F.col("whole") & (F.col("money") | (F.col("high") / F.col("positive") >= WIDE))
    stats = stats.withColumn("is_log", may & F.coalesce("log", wide)).withColumn("safe", F.greatest("positive", F.lit(TINY), "floor"))
    stats = stats.withColumn("has_floor", F.col("is_log") & (F.col("low") <= F.col("safe")) & (F.col("high") > F.col("safe")))
    start = F.when(F.col("has_floor"), F.ln("safe")).when(F.col("is_log"), F.ln(F.greatest("low", "safe"))).when(F.col("low") == F.col("high"), F.col("low") - 0.5).otherwise(F.col("low"))
    end = F.when(F.col("is_log"), F.ln(F.greatest("high", "safe"))).when(F.col("low") == F.col("high"), F.col("high") + 0.5).otherwise(F.col("high"))
    stats = stats.withColumns({"start": start, "end": end, "n_even": F.col("bins") - F.col("has_floor").cast("int")})
    flat = F.col("start") == F.col("end")
    stats = stats.withColumns({"start": F.when(flat, F.col("start") - 0.5).otherwise(F.col("start")), "end": F.when(flat, F.col("end") + 0.5).otherwise(F.col("end"))})
    scaled = F.when(F.col("is_log"), F.ln(F.greatest("value", "safe"))).otherwise(F.col("value"))
    even = F.floor((scaled - F.col("start")) / (F.col("end") - F.col("start")) * F.col("n_even"))
    even = F.greatest(F.lit(0), F.least(even, F.col("n_even") - 1)) + F.col("has_floor").cast("int")
    place = F.when(F.col("has_floor") & (F.col("value") <= F.col("safe")), 0).otherwise(even).cast("int")
    slim = stats.select("metric", "is_log", "safe", "has_floor", "start", "end", "n_even")
    counts = known.join(F.broadcast(slim), "metric").groupBy("metric", place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    bins = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    edge = lambda k: F.col("start") + (F.col("end") - F.col("start")) * k / F.col("n_even")
    number = F.col("bin") - F.col("has_floor").cast("int")
    shown = lambda x: F.when(F.col("is_log"), F.exp(x)).otherwise(x)
    lower = F.when(F.col("has_floor") & (F.col("bin") == 0), F.col("low")).when(F.col("has_floor") & (F.col("bin") == 1), F.col("safe")).otherwise(shown(edge(number)))
    upper = F.when(F.col("has_floor") & (F.col("bin") == 0), F.col("safe")).when((F.col("bin") == F.col("bins") - 1) & (F.col("low") != F.col("high")), F.col("high")).otherwise(shown(edge(number + 1)))
    p5, p95 = (F.when(F.col("n") >= ENOUGH, F.get("p", F.lit(k))).otherwise(F.col(c)) for k, c in ((0, "low"), (1, "high")))
    return bins.join(counts, ["metric", "bin"], "left").select(
        "metric", "bin", lower.alias("lower"), upper.alias("upper"), F.coalesce("count", F.lit(0)).alias("count"), "is_log",
        F.when(p5 <= p95, p5).otherwise(F.col("low")).alias("suggested_low"), F.when(p5 <= p95, p95).otherwise(F.col("high")).alias("suggested_high"),
    )
