"""Comparison with the window before: sums of a week against the preceding week and a trailing mean.

Facts become one row per entity and day first (map-side combined).  The sums of
days change only where a fact enters or leaves a window, so only such days are sorted and summed;
the days between take over the sums of the day before, from an entity's first day to the last one asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def daily_rollup(facts: DataFrame, entity: str, time: str, **measures) -> DataFrame:
    """(entity, day, measures): one row per entity and day; rows without either are left out."""
    return (facts.where(F.col(entity).isNotNull() & F.col(time).isNotNull())
            .groupBy(F.col(entity).alias("entity_id"), F.to_date(time).alias("day")).agg(*(c.alias(n) for n, c in measures.items())))


def compared_windows(rollup: DataFrame, measure: str, as_of, days: int = 7, trail: int = 28) -> DataFrame:
    """(entity_id, day, value, previous, trailing_mean, change) for each day from an entity's first one to ``as_of``.

    ``value`` is the sum over the ``days`` days that end with the day, ``previous`` that of the ``days`` before, ``trailing_mean`` the mean
    per ``days`` days of the ``trail`` days before the window.  ``previous`` and ``trailing_mean`` are null until
    the entity has been seen for so many days before; days without facts count 0.  ``change`` is value / previous - 1, null if previous is null or 0.
    """
    last, number = F.lit(as_of).cast("date"), F.datediff("day", F.lit("1970-01-01").cast("date"))
    in_order = Window.partitionBy("entity_id").orderBy("_n")
    total = lambda a, b: F.coalesce(F.sum(measure).over(in_order.rangeBetween(a, b)), F.lit(0)).cast("double")
    # a fact enters or leaves one of the sums on these days only; what follows stays in the entity's task
    turns = F.explode(F.array(*(F.lit(k) for k in sorted({0, days, 2 * days, days + trail})))).alias("_k")
    rows = (rollup.where(F.col("day") <= last).select("entity_id", "day", measure).repartition("entity_id").select("*", turns)
            .select("entity_id", F.date_add("day", F.col("_k")).alias("day"), F.when(F.col("_k") == 0, F.col(measure)).alias(measure))
            .where(F.col("day") <= last).withColumn("_n", number))
    rows = rows.select(
        "entity_id", "day", F.min("day").over(Window.partitionBy("entity_id")).alias("_first"), F.lead("day").over(in_order).alias("_next"),
        total(-days + 1, 0).alias("value"), total(-2 * days + 1, -days).alias("previous"), (total(-days - trail + 1, -days) * days / trail).alias("trailing_mean"))
    # the sums hold until the day before the next such day; of equal days the last one stays
    until = F.coalesce(F.date_sub("_next", 1), last)
    rows = rows.where(F.col("day") <= until).withColumn("day", F.explode(F.sequence("day", until)))
    seen = F.datediff("day", "_first")
    rows = rows.select("entity_id", "day", "value", F.when(seen >= 2 * days - 1, F.col("previous")).alias("previous"),
                       F.when(seen >= days + trail - 1, F.col("trailing_mean")).alias("trailing_mean"))
    return rows.withColumn("change", F.when(F.col("previous") != 0, F.col("value") / F.col("previous") - 1))


def alert_against_previous(rollup: DataFrame, measure: str, as_of, max_change: float = -0.3, min_previous: float = 1.0, days: int = 7) -> DataFrame:
    """Rows of ``compared_windows`` on ``as_of`` whose value fell by more than ``max_change`` from a window of at least ``min_previous``."""
    on_day = compared_windows(rollup, measure, as_of, days).where(F.col("day") == F.lit(as_of).cast("date"))
    return on_day.where((F.col("previous") >= min_previous) & (F.col("change") <= max_change))
