"""Small time series: periods, latest values, bins, and a local regression."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_period(rows: DataFrame, date: Column, start: str) -> DataFrame:
    return rows.withColumn("period", F.when(date < F.lit(start).cast("date"), "before").otherwise("campaign"))


def latest(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """One row per group: the first by ``order``."""
    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where("_nth = 1").drop("_nth")


def ranked_weeks(weeks: DataFrame) -> DataFrame:
    """(week, index, step): consecutive numbers, and the difference from the week before (0 or 1 in a sound index)."""
    order = Window.orderBy("week")  # one row per week
    return weeks.select("week").distinct().withColumn("index", F.dense_rank().over(order)).withColumn("step", F.col("index") - F.lag("index").over(order))


def time_bins(rows: DataFrame, seconds: Column, bins: int) -> DataFrame:
    """``bin`` from 1: equal spans between the first and the last moment."""
    low, high = rows.agg(F.min(seconds), F.max(seconds)).first()
    width = ((high - low) / bins) or 1
    return rows.withColumn("bin", F.least(F.lit(bins), F.floor((seconds - F.lit(low)) / F.lit(width)) + 1).cast("int"))


def _smooth(x: np.ndarray, y: np.ndarray, span: float) -> np.ndarray:
    """Local quadratic fit at each x with tricube weights over the nearest ``span`` of the points."""
    n = len(x)
    k = min(n, max(3, int(np.ceil(span * n))))
    out = np.empty(n)
    for i in range(n):
        gap = np.abs(x - x[i])
        reach = np.partition(gap, k - 1)[k - 1] or 1.0
        w = np.sqrt(np.clip(1 - np.minimum(gap / reach, 1) ** 3, 0, None) ** 3)
        near = w > 0
        d = x[near] - x[i]
        powers = np.vander(d / reach, min(3, max(1, len(np.unique(d)))), increasing=True)
        out[i] = np.linalg.lstsq(powers * w[near, None], y[near] * w[near], rcond=None)[0][0]
    return out


def loess(series: DataFrame, span: float = 0.75) -> DataFrame:
    """(series, x, y, fit) from (series, x, y). Each series is one short run of points, such as weekly values."""

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.dropna().sort_values(["x", "y"], ignore_index=True)
        rows["fit"] = _smooth(rows["x"].to_numpy(float), rows["y"].to_numpy(float), span) if len(rows) else np.zeros(0)
        return rows

    return series.select("series", F.col("x").cast("double"), F.col("y").cast("double")).groupBy("series").applyInPandas(fit, "series string, x double, y double, fit double")
