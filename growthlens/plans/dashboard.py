"""Merchant dashboard (#68): overview, retention, segments, item lists and advice
as one tall (section, entity, metric, value, text) frame.

Three passes over the log: plain totals, the (user, day) rollup, and the
per-item funnel.  Each is written once to the shared checkpoint folder, far
smaller than the log, and every part is built on them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthlens.functions.columns import ACTIONS, action_strict, resolve_columns
from growthlens.operators import behavior as B
from growthlens.operators import funnel as FN
from growthlens.session import settle

_COLS = ("section", "entity", "metric", "value", "text")


def _rows(df: DataFrame, section: str, entity: str | None, metrics: tuple[str, ...],
          texts: tuple[str, ...] = ()) -> DataFrame:
    """One (section, entity, metric, value, text) row per listed metric / text column.

    Written as one SQL expression so the frame is built in a single call.
    """
    cells = [f"named_struct('metric', '{m}', 'value', CAST(`{m}` AS DOUBLE), "
             f"'text', CAST(NULL AS STRING))" for m in metrics]
    cells += [f"named_struct('metric', '{t}', 'value', CAST(NULL AS DOUBLE), "
              f"'text', CAST(`{t}` AS STRING))" for t in texts]
    ent = f"CAST(`{entity}` AS STRING)" if entity else "CAST(NULL AS STRING)"
    return df.selectExpr(f"'{section}' AS section", f"{ent} AS entity",
                         f"inline(array({', '.join(cells)}))").select(*_COLS)


def merchant_dashboard(behavior: DataFrame, funnel: DataFrame | None = None,
                       items_limit: int = 20, min_pv: int = 0, roles: dict | None = None) -> DataFrame:
    if funnel is None:
        funnel = FN.item_funnel_loose(FN.user_item_stage(FN.behavior_norm(behavior, roles)))
    funnel, days = settle(funnel), settle(B.user_day_rollup(behavior, roles))
    parts = []
    r = resolve_columns(behavior, roles)
    k = action_strict(F.col(r["action"]))
    item = F.col(r["item"])
    # totals and items: each item once, combined map-side
    per_item = settle(behavior.groupBy(item.alias("item")).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(k == F.lit(a)).alias(a) for a in ACTIONS]))
    glob = per_item.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("user_behavior_rows"), F.count("item").alias("distinct_items"),
                        *[F.coalesce(F.sum(a), F.lit(0)).cast("bigint").alias(a) for a in ACTIONS])
    users = days.groupBy("user_id").agg(F.lit(1).alias("one")).select(F.count("user_id")).scalar()
    ov = glob.withColumn("distinct_users", users).withColumn("item_funnel_features_rows", funnel.select(F.count(F.lit(1))).scalar())
    parts.append(_rows(ov, "overview", None, ("user_behavior_rows", "distinct_users",
                                               "distinct_items", "item_funnel_features_rows")))
    totals = glob.select(*ACTIONS)
    counts = B.behavior_counts(behavior, roles, totals=totals)
    parts.append(_rows(counts, "behavior_counts", "action", ("cnt",)))
    d1 = B.d1_retention_latest(behavior, roles, rollup=days)
    parts.append(_rows(d1, "d1_retention", "day", ("active_users", "retained_users", "rate")))
    rep = B.repurchase_7d(behavior, roles, rollup=days)
    parts.append(_rows(rep, "repurchase_7d", None, ("buyers", "repurchasers_7d", "rate")))
    seg = B.lifecycle_segments(behavior, roles, rollup=days)
    parts.append(_rows(seg, "lifecycle", "segment", ("users", "share", "avg_actions"), ("anchor_day",)))
    item_cols = ("pv", "fav", "cart", "buy", "pv_to_buy_rate")
    parts.append(_rows(FN.items_top(funnel, items_limit, min_pv), "items_top", "item_id", item_cols))
    parts.append(_rows(FN.items_opportunity(funnel, items_limit, max(50, min_pv)), "items_opportunity",
                       "item_id", item_cols))
    journey = B.journey_rates(behavior, roles, totals=totals)
    parts.append(_rows(journey, "advice_journey", "key", ("rate",),
                       ("default_segment", "default_message_type")))
    advice = B.lifecycle_advice(behavior, roles, repurchase=rep, d1_latest=d1)
    parts.append(_rows(advice, "advice_lifecycle", "key", (),
                       ("default_segment", "default_message_type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
