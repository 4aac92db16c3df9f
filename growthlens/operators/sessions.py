"""Sessions by pauses, and the steps taken inside them.

Events first fall into cells as wide as the longest pause a session may hold.
Events of one cell always share a session, so a cell becomes one row by
map-side combined minima, maxima and counts: a user with a third of the log
is reduced in every task that reads the log, before anything is shuffled.
What is left per user is at most one row for each cell of the time that the log
spans.  Sessions are then cut between neighbouring cells of a user and merged
across the cell edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STEPS = ("pv", "fav", "cart", "buy")


def _micros(name: str):
    return F.unix_micros(F.col(name).cast("timestamp"))


def _cells(events: DataFrame, width: int) -> DataFrame:
    """(user_id, cell, lo, hi, n_events, n_<step>, t_<step>) of the events in each cell of ``width`` microseconds."""
    known = events.where(F.col("user_id").isNotNull() & F.col("ts").isNotNull()).select("user_id", "action", _micros("ts").alias("t"))
    is_step = {s: F.col("action") == s for s in STEPS}
    return known.groupBy("user_id", F.floor(F.col("t") / width).cast("long").alias("cell")).agg(
        F.min("t").alias("lo"), F.max("t").alias("hi"), F.count("*").alias("n_events"),
        *(F.count(F.when(is_step[s], 1)).alias(f"n_{s}") for s in STEPS),
        *(F.min(F.when(is_step[s], F.col("t"))).alias(f"t_{s}") for s in STEPS))


def sessions(events: DataFrame, pause_minutes: int = 30) -> DataFrame:
    """(user_id, session_no, started, ended, n_events, n_pv ... n_buy, t_pv ... t_buy) of ``events(user_id, action, ts)``.

    A pause of more than ``pause_minutes`` ends a session; one of exactly that does not.
    ``n_<step>`` counts the events of a step, ``t_<step>`` is its first time in
    the session or null.  ``session_no`` counts a user's sessions from 1.  Other actions keep a session alive.
    Events without a user or a time are left out; an empty log gives no rows.
    """
    if pause_minutes <= 0:
        raise ValueError("pause_minutes must be positive")
    width = pause_minutes * 60_000_000
    in_order = Window.partitionBy("user_id").orderBy("cell")
    begins = F.coalesce(F.col("lo") - F.lag("hi").over(in_order) > width, F.lit(True))
    numbered = _cells(events, width).withColumn("begins", begins.cast("int")).withColumn("session_no", F.sum("begins").over(in_order))
    time = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return numbered.groupBy("user_id", "session_no").agg(
        time(F.min("lo")).alias("started"), time(F.max("hi")).alias("ended"), F.sum("n_events").alias("n_events"),
        *(F.sum(f"n_{s}").alias(f"n_{s}") for s in STEPS), *(time(F.min(f"t_{s}")).alias(f"t_{s}") for s in STEPS))


def session_step_rates(found: DataFrame) -> DataFrame:
    """Per day on which sessions began: how many there were, how long, and how many went from step to step.

    A step counts if the session holds it and every step before, each first met no
    earlier than the one before it.  Rates are null where nothing reached the step before;
    ``avg_minutes`` is taken from first to last event.
    """
    reached, steps = F.col("t_pv").isNotNull(), []
    for before, step in zip((None, *STEPS), STEPS):
        if before:
            reached = reached & F.col(f"t_{step}").isNotNull() & (F.col(f"t_{step}") >= F.col(f"t_{before}"))
        steps.append(F.count(F.when(reached, 1)).alias(step))
    length = F.unix_micros(F.col("ended").cast("timestamp")) - F.unix_micros(F.col("started").cast("timestamp"))
    days = found.groupBy(F.to_date("started").alias("day")).agg(
        F.count("*").alias("sessions"), F.sum("n_events").alias("events"),
        F.count(F.when(F.col("n_events") == 1, 1)).alias("single_event"), (F.sum(length) / F.count("*") / 60_000_000).alias("avg_minutes"), *steps)
    rate = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return days.select("*", *(rate(b, a).alias(f"{a}_to_{b}") for a, b in zip(STEPS, STEPS[1:])))
