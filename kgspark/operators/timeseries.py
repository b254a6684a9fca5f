"""Rolling anomaly detectors over points (label, timestamp, value): z-score, quartile range, trend, ensemble.

Each gives score, threshold, is_anomaly and method beside its points. A series is one label, ordered by
timestamp and tie; whole=True takes all points as one series. A series of more than BLOCK points is cut into
blocks of that many, each with the points before it that its first windows look back to, so no task holds
more; points of one timestamp have a fixed order only with a tie.
"""

from __future__ import annotations

from functools import reduce

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kgspark.checkpoints import saved

WARM_UP = 10
#: Points of a series that one task takes at once.
BLOCK = 200_000


def series(points: DataFrame, tie: str | None, whole: bool, back: int) -> tuple[DataFrame, list[str], list[str]]:
    """The points with a column _own, what a group of them is told by, and their order in it.

    Where a series is too long for one group, its points are sorted over all tasks and numbered, and the last
    `back` points of each block stand in the next one, too; there _own is false.
    """
    keys, order = [] if whole else ["label"], ["timestamp", *([tie] if tie else [])]
    longest = points.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if longest <= BLOCK or back >= BLOCK:
        return points.withColumn("_own", F.lit(True)), keys, order
    own = [*keys, *order]
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = saved(points.repartitionByRange(*own).sortWithinPartitions(*own).select("*", F.spark_partition_id().alias("_part"), number.alias("_at")), "series")
    starts = rows.groupBy(*keys, "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_part")) - F.col("_n")
    starts = starts.select(*keys, "_part", (before - F.col("_first")).alias("_shift"))
    placed = rows.join(starts, [*keys, "_part"]).withColumn("_place", F.col("_at") + F.col("_shift"))
    block = F.floor(F.col("_place") / BLOCK)
    both = F.when(F.col("_place") % BLOCK >= BLOCK - back, F.array(block, block + 1)).otherwise(F.array(block))
    return placed.withColumn("_block", F.explode(both)).withColumn("_own", F.col("_block") == block), [*keys, "_block"], ["_place"]


def z_scores(points: DataFrame, window: int = 100, z: float = 3.0, tie: str | None = None, whole: bool = False) -> DataFrame:
    """|x - mean| / deviation over the last `window` points, this one included; none before the tenth point
    of a window or without deviation, so a window under ten gives nothing."""
    own, keys, order = series(points, tie, whole, window - 1)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(window - 1), 0)
    x = F.col("value")
    stats = own.select("*", F.avg(x).over(w).alias("_mean"), F.stddev_pop(x).over(w).alias("_dev"), F.count(x).over(w).alias("_count")).where(F.col("_own") & (F.col("_count") >= WARM_UP) & (F.col("_dev") > 0))
    score = F.abs(x - F.col("_mean")) / F.col("_dev")
    return stats.select(*points.columns, score.alias("score"), (F.col("_mean") + z * F.col("_dev")).alias("threshold"), (score > z).alias("is_anomaly"), F.lit("z_score").alias("method"))


def quartile_ranges(points: DataFrame, window: int = 100, multiplier: float = 1.5, tie: str | None = None, whole: bool = False) -> DataFrame:
    """Quartiles by index without interpolation over the last `window` points; outside of q1 - m iqr to q3 + m iqr.

    The score is the distance from the middle in ranges; with a range of zero it is null, or infinite off the middle.
    """
    own, keys, order = series(points, tie, whole, window - 1)
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(window - 1), 0)
    x, n = F.col("value"), F.size("_sorted")
    at = lambda q: F.element_at("_sorted", (F.floor(n * q) + 1).cast("int"))
    rows = own.withColumn("_sorted", F.sort_array(F.collect_list(x).over(w))).where(F.col("_own") & (n >= WARM_UP))
    rows = rows.select(*points.columns, at(0.25).alias("_q1"), at(0.75).alias("_q3"))
    iqr = F.col("_q3") - F.col("_q1")
    low, high = F.col("_q1") - multiplier * iqr, F.col("_q3") + multiplier * iqr
    middle = F.abs(x - (F.col("_q1") + F.col("_q3")) / 2)
    score = F.when(iqr != 0, middle / iqr).when(middle > 0, F.lit(float("inf")))
    return rows.select(*points.columns, score.alias("score"), F.when(x > F.col("_q3"), high).otherwise(low).alias("threshold"), ((x < low) | (x > high)).alias("is_anomaly"), F.lit("iqr").alias("method"))


def trends(points: DataFrame, alpha: float = 0.1, limit: float = 0.3, window: int = 50, tie: str | None = None, whole: bool = False) -> DataFrame:
    """|mean of the last `window` points - exponential mean| / max(|exponential mean|, 1), from the first point on.

    The exponential mean forgets: what is older than about 42 / alpha points is under the last bit of a double.
    A block looks back that far and begins there; where that is longer than a block, a series is one group.
    """
    back = max(window - 1, math.ceil(-60 * math.log(2) / math.log1p(-alpha)) if alpha < 1 else 0)
    own, keys, order = series(points, tie, whole, back)
    names = points.columns

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        ema = pdf["value"].ewm(alpha=alpha, adjust=False).mean()
        recent = pdf["value"].rolling(window, min_periods=1).mean()
        score = (recent - ema).abs() / ema.abs().clip(lower=1.0)
        return pdf[names].assign(score=score, threshold=limit, is_anomaly=score > limit, method="trend")[pdf["_own"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in points.schema.fields)
    return own.groupBy(*keys).applyInPandas(run, f"{fields}, score double, threshold double, is_anomaly boolean, method string")


def ensemble(results: list[DataFrame], share: float = 0.6, key: tuple[str, ...] = ("label", "timestamp")) -> DataFrame:
    """All detectors' rows of a point; if at least share of all detectors flag it, every row is flagged and its method says so."""
    every = reduce(DataFrame.unionByName, results)
    votes = F.sum(F.col("is_anomaly").cast("int")).over(Window.partitionBy(*key))
    agreed: Column = votes >= share * len(results)
    flagged = every.withColumn("_agreed", agreed)
    return flagged.select(*(c for c in every.columns if c not in ("is_anomaly", "method")), (F.col("is_anomaly") | F.col("_agreed")).alias("is_anomaly"), F.when(F.col("_agreed"), F.concat(F.lit("ensemble_"), F.col("method"))).otherwise(F.col("method")).alias("method"))


def security_preset(points: DataFrame, tie: str | None = None, whole: bool = False, key: tuple[str, ...] = ("label", "timestamp")) -> DataFrame:
    """z-score over 100 points at 3, quartile range over 100 at 1.5, trend 0.1 / 0.3 / 50; three fifths agree."""
    return ensemble([z_scores(points, 100, 3.0, tie, whole), quartile_ranges(points, 100, 1.5, tie, whole), trends(points, 0.1, 0.3, 50, tie, whole)], 0.6, key)


def last_counts(points: DataFrame, tie: str | None = None) -> DataFrame:
    """label and its latest value, by timestamp and tie."""
    return points.groupBy("label").agg(F.max_by("value", F.struct("timestamp", *([tie] if tie else []))).alias("value"))
