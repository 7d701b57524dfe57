"""Returns and volatility in a window after each event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def window_returns(
    events: DataFrame, prices: DataFrame, entity: str = "ticker", event_date: str = "filing_date", price_date: str = "date", price: str = "close",
    lag_days: int = 2, window_days: int = 365, min_observations: int = 200, return_col: str = "return_next_year", vol_col: str = "vol_next_year", periods: float = 252.0,
) -> DataFrame:
    """Events with the log return and the annualised volatility of the closes in [event + lag, event + lag + window], both days included.

    The window is a range condition beside the entity's equality, so the join is
    by hash or sort-merge. Returns between neighbouring closes are taken once for
    the series; one counts for a window if its earlier close lies in it, too.
    Events with fewer than min_observations closes keep their row with NULLs.
    """
    w = Window.partitionBy(entity).orderBy(price_date)
    series = prices.select(entity, F.col(price_date).alias("__date"), F.col(price).alias("__price")).filter(F.col("__price").isNotNull())
    series = series.withColumnRenamed(entity, "__entity")
    w = Window.partitionBy("__entity").orderBy("__date")
    series = series.withColumns({"__before": F.lag("__price").over(w), "__before_date": F.lag("__date").over(w)})
    keys = events.select(entity, F.col(event_date).alias("__event")).filter(F.col("__event").isNotNull()).distinct()
    start = F.date_add("__event", lag_days)
    joined = keys.join(series, (F.col(entity) == F.col("__entity")) & F.col("__date").between(start, F.date_add("__event", lag_days + window_days)))
    step = F.when((F.col("__before_date") >= start) & (F.col("__before") > 0) & (F.col("__price") > 0), F.ln(F.col("__price") / F.col("__before")))
    last, first = F.max_by("__price", "__date"), F.min_by("__price", "__date")
    found = joined.groupBy(entity, "__event").agg(
        F.count("*").alias("__n"), F.when((first > 0) & (last > 0), F.ln(last / first)).alias(return_col), (F.stddev_samp(step) * F.sqrt(F.lit(periods))).alias(vol_col)
    ).filter(F.col("__n") >= min_observations)
    found = found.drop("__n").withColumnsRenamed({entity: "__entity"})
    on = (events[entity] == found["__entity"]) & (events[event_date] == found["__event"])
    return events.join(found, on, "left").drop("__entity", "__event")
