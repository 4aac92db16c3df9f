"""Item conversion funnels.

Two families, as in the analysed application:

* distinct-user funnels (#28-#34): earliest time of each action per
  (user, item), then per-item counts of users whose later stages follow the
  view -- loosely (>=) or strictly ordered (pv < fav < cart < buy);
* event-count funnels over a look-back window (#35-#38) with drop-off
  thresholds, advice lists and a conclusion band.

Both aggregate with map-side partial aggregation, so a hot item or user
never has its raw rows gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.functions.columns import (
    ACTIONS,
    action_from_int_or_text,
    as_ts_column,
    epoch_seconds,
    long_or_null,
    parse_event_ts,
    pick_column,
    ratio_or_null,
    ratio_or_zero,
    resolve_columns,
)
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values of the analysed application
# ---------------------------------------------------------------------------
RATE_CHECK_LIMIT = 1.00001
# drop-off stages: stage, threshold (%), issue
DROP_OFF_RULES = (
    ("pv_to_cart", 5.0, "加购率偏低"),
    ("cart_to_fav", 10.0, "收藏率偏低"),
    ("fav_to_buy", 20.0, "购买转化率偏低"),
)
REC_NO_EXPOSURE = "提升曝光量：增加商品推广和内容营销"
REC_DETAIL_PAGE = "优化商品详情页：提升加购率，改善商品描述和图片"
REC_ATTRACTION = "增强商品吸引力：优化价格策略，增加优惠活动"
REC_PURCHASE = "促进购买转化：发送优惠提醒，优化购买流程"
REC_OVERALL = "整体优化：提升商品质量和用户信任度"
REC_GOOD = "漏斗表现良好，继续保持"
CONCLUSION_NO_PV = "无曝光数据，需要提升商品曝光"
CONCLUSION_NO_BUY = "有曝光但无购买，转化率需要优化"
CONCLUSION_LOW = "转化率偏低（%.2f%%），存在优化空间"
CONCLUSION_FAIR = "转化率一般（%.2f%%），可进一步提升"
CONCLUSION_GOOD = "转化率良好（%.2f%%），表现优秀"
LOOKBACK_MIN, LOOKBACK_MAX = 1, 90
# accepted column names of a funnel table, in order
FUNNEL_ROLES = {
    "item_id": ("item_id", "item", "id"),
    "pv": ("pv", "pv_cnt", "pv_count", "pv_n"),
    "fav": ("fav", "fav_cnt", "fav_count", "fav_n"),
    "cart": ("cart", "cart_cnt", "cart_count", "cart_n"),
    "buy": ("buy", "buy_cnt", "buy_count", "buy_n"),
    "pv_to_buy_rate": ("pv_to_buy_rate", "pv_to_buy", "pv_buy_rate"),
}


# ---------------------------------------------------------------------------
# #10 normalisation (used by the funnel builder)
# ---------------------------------------------------------------------------
def behavior_norm(df: DataFrame, roles: dict | None = None) -> DataFrame:
    """Canonical (user_id, item_id, action, ts) with ts in epoch seconds.

    Rows with any NULL input are dropped; integer-looking actions map 1..4 to
    names (other numbers NULL), text is lower-cased; integral times are kept,
    timestamps / time strings become epoch seconds.
    """
    r = resolve_columns(df, roles)
    u, i, a, t = (F.col(r[k]) for k in ("user", "item", "action", "ts"))
    dt = df.schema[r["ts"]].dataType
    if isinstance(dt, (T.LongType, T.IntegerType, T.ShortType)):
        ts = t.cast("bigint")
    elif isinstance(dt, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        ts = epoch_seconds(t.cast("timestamp_ntz"))
    else:
        ts = F.coalesce(long_or_null(t),
                        epoch_seconds(parse_event_ts(df, r["ts"])))
    return (df.where(u.isNotNull() & i.isNotNull() & a.isNotNull() & t.isNotNull())
            .select(u.cast("bigint").alias("user_id"), i.cast("bigint").alias("item_id"),
                    action_from_int_or_text(a).alias("action"), ts.alias("ts")))


# ---------------------------------------------------------------------------
# #28 - #34 distinct-user funnels
# ---------------------------------------------------------------------------
def user_item_stage(norm: DataFrame) -> DataFrame:
    """Earliest time of each of the four actions per (user, item)."""
    valid = norm.where(F.col("action").isin(*ACTIONS) & F.col("ts").isNotNull())
    return valid.groupBy("user_id", "item_id").agg(
        *[F.min(F.when(F.col("action") == a, F.col("ts"))).alias(f"{a}_ts") for a in ACTIONS])


def _stage_conditions(strict: bool) -> dict[str, Column]:
    pv, fav, cart, buy = (F.col(f"{a}_ts") for a in ACTIONS)
    if not strict:
        return {
            "fav": pv.isNotNull() & fav.isNotNull() & (fav >= pv),
            "cart": pv.isNotNull() & cart.isNotNull() & (cart >= pv),
            "buy": pv.isNotNull() & buy.isNotNull() & (buy >= pv),
            "fav_cart": fav.isNotNull() & cart.isNotNull() & (cart >= fav),
            "cart_buy": cart.isNotNull() & buy.isNotNull() & (buy >= cart),
        }
    fav_ok = pv.isNotNull() & fav.isNotNull() & (fav > pv)
    cart_ok = fav_ok & cart.isNotNull() & (cart > fav)
    return {
        "fav": fav_ok,
        "cart": cart_ok,
        "buy": cart_ok & buy.isNotNull() & (buy > cart),
        "fav_cart": fav.isNotNull() & cart.isNotNull() & (cart > fav),
        "cart_buy": cart.isNotNull() & buy.isNotNull() & (buy > cart),
    }


def _flag(c: Column) -> Column:
    return F.sum(F.when(c, 1).otherwise(0)).cast("bigint")


def _funnel_aggs(strict: bool, prefix: str = "") -> list[Column]:
    cond = _stage_conditions(strict)
    return [_flag(F.col("pv_ts").isNotNull()).alias(f"{prefix}pv"),
            _flag(cond["fav"]).alias(f"{prefix}fav"),
            _flag(cond["cart"]).alias(f"{prefix}cart"),
            _flag(cond["buy"]).alias(f"{prefix}buy"),
            _flag(cond["fav_cart"]).alias(f"{prefix}_fav_cart"),
            _flag(cond["cart_buy"]).alias(f"{prefix}_cart_buy")]


def _funnel_columns(prefix: str = "") -> list[Column]:
    pv, fav, cart, buy = (F.col(f"{prefix}{a}") for a in ACTIONS)
    return [pv.alias("pv"), fav.alias("fav"), cart.alias("cart"), buy.alias("buy"),
            *[F.col(f"{prefix}{a}").alias(f"{a}_count") for a in ACTIONS],
            ratio_or_null(fav, pv).alias("pv_to_fav_rate"),
            ratio_or_null(cart, pv).alias("pv_to_cart_rate"),
            ratio_or_null(buy, pv).alias("pv_to_buy_rate"),
            ratio_or_null(F.col(f"{prefix}_fav_cart"), fav).alias("fav_to_cart_rate"),
            ratio_or_null(F.col(f"{prefix}_cart_buy"), cart).alias("cart_to_buy_rate")]


def item_funnel(stage: DataFrame, strict: bool = False) -> DataFrame:
    """Per item: distinct users per stage, duplicate ``*_count`` columns and rates."""
    agg = stage.groupBy("item_id").agg(*_funnel_aggs(strict))
    return agg.select("item_id", *_funnel_columns())


def item_funnel_loose(stage: DataFrame) -> DataFrame:
    return item_funnel(stage, strict=False)


def item_funnel_strict(stage: DataFrame) -> DataFrame:
    return item_funnel(stage, strict=True)


def item_funnel_both(stage: DataFrame) -> DataFrame:
    """Loose and strict funnels stacked, flagged by ``strict`` 0/1.

    Both are computed in one aggregation over the stage table and then split
    into two rows per item.
    """
    agg = stage.groupBy("item_id").agg(*_funnel_aggs(False, "l_"), *_funnel_aggs(True, "s_"))
    rows = [F.struct(F.lit(flag).alias("strict"), *_funnel_columns(prefix))
            for flag, prefix in ((0, "l_"), (1, "s_"))]
    out = agg.select("item_id", F.inline(F.array(*rows)))
    return out.select("strict", "item_id", *[c for c in out.columns if c not in ("strict", "item_id")])


def funnel_rate_check(funnel: DataFrame) -> DataFrame:
    """Rows whose pv->buy rate exceeds 1 (with tolerance) and the largest rate."""
    return funnel.agg(
        _flag(F.col("pv_to_buy_rate") > RATE_CHECK_LIMIT).alias("bad_rate_rows"),
        F.max("pv_to_buy_rate").alias("max_rate"))


def _ranked_items(funnel: DataFrame) -> DataFrame:
    """(item_id, pv, fav, cart, buy, pv_to_buy_rate) of a funnel table under any of the accepted column names."""
    found = {role: pick_column(funnel.columns, names, case_insensitive=False) for role, names in FUNNEL_ROLES.items()}
    missing = [role for role in ("item_id", "pv", "buy") if found[role] is None]
    if missing:
        raise ValueError(f"funnel table lacks {missing}; has {funnel.columns}")
    col = lambda role: F.col(f"`{found[role]}`") if found[role] else F.lit(0).cast("bigint")
    rate = col("pv_to_buy_rate") if found["pv_to_buy_rate"] else ratio_or_null(col("buy"), col("pv"))
    return funnel.select(*[col(role).alias(role) for role in ("item_id", *ACTIONS)], rate.alias("pv_to_buy_rate"))


def _present(df: DataFrame) -> DataFrame:
    return df.select("item_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
                                  for c in ACTIONS],
                     F.coalesce(F.col("pv_to_buy_rate"), F.lit(0.0)).alias("pv_to_buy_rate"))


def items_top(funnel: DataFrame, limit: int = 20, min_pv: int = 0) -> DataFrame:
    """Best converting items: rate desc (NULLs last), then views desc, then id."""
    ranked = _ranked_items(funnel)
    if min_pv > 0:
        ranked = ranked.where(F.col("pv") >= int(min_pv))
    top = ranked.orderBy(F.col("pv_to_buy_rate").desc_nulls_last(), F.col("pv").desc(),
                         F.col("item_id").asc()).limit(int(limit))
    return _present(top)


def items_opportunity(funnel: DataFrame, limit: int = 20, min_pv: int = 50) -> DataFrame:
    """High traffic, low conversion: views >= min_pv, views desc, rate asc (NULLs last)."""
    ranked = _ranked_items(funnel).where(F.col("pv") >= int(min_pv))
    top = ranked.orderBy(F.col("pv").desc(), F.col("pv_to_buy_rate").asc_nulls_last(),
                         F.col("item_id").asc()).limit(int(limit))
    return _present(top)


# ---------------------------------------------------------------------------
# #35 - #38 event-count funnel over a look-back window
# ---------------------------------------------------------------------------
def _window_counts(behavior: DataFrame, as_of=None, lookback_days: int = 7,
                   roles: dict | None = None) -> DataFrame:
    if not LOOKBACK_MIN <= int(lookback_days) <= LOOKBACK_MAX:
        raise ValueError(f"lookback_days must be in [{LOOKBACK_MIN}, {LOOKBACK_MAX}]")
    r = resolve_columns(behavior, roles)
    ts = parse_event_ts(behavior, r["ts"])
    end = as_ts_column(as_of)
    start = F.timestamp_add("DAY", F.lit(-int(lookback_days)), end)
    ev = behavior.where((ts >= start) & (ts <= end))
    act = F.col(r["action"]).cast("string")
    counts = ev.groupBy(F.col(r["item"]).alias("item_id")).agg(
        *[F.count_if(act == F.lit(a)).alias(a) for a in ("pv", "cart", "fav", "buy")])
    pv, cart, fav, buy = (F.col(a) for a in ("pv", "cart", "fav", "buy"))
    return counts.select(
        "item_id", "pv", "cart", "fav", "buy",
        ratio_or_zero(cart, pv, 100.0).alias("r_pv_cart"),
        ratio_or_zero(fav, cart, 100.0).alias("r_cart_fav"),
        ratio_or_zero(buy, fav, 100.0).alias("r_fav_buy"),
        ratio_or_zero(buy, pv, 100.0).alias("r_pv_buy"))


def item_funnel_window(behavior: DataFrame, as_of=None, lookback_days: int = 7,
                       roles: dict | None = None) -> DataFrame:
    """Per item event counts pv -> cart -> fav -> buy in [as_of - N days, as_of], rates in %."""
    c = _window_counts(behavior, as_of, lookback_days, roles)
    return c.select("item_id", "pv", "cart", "fav", "buy",
                    F.round("r_pv_cart", 2).alias("pv_to_cart_rate"),
                    F.round("r_cart_fav", 2).alias("cart_to_fav_rate"),
                    F.round("r_fav_buy", 2).alias("fav_to_buy_rate"),
                    F.round("r_pv_buy", 2).alias("pv_to_buy_rate"))


def funnel_drop_offs(behavior: DataFrame, as_of=None, lookback_days: int = 7,
                     roles: dict | None = None) -> DataFrame:
    """Stages under their threshold (only where the stage base is non-zero)."""
    c = _window_counts(behavior, as_of, lookback_days, roles)
    bases = {"pv_to_cart": ("pv", "r_pv_cart"), "cart_to_fav": ("cart", "r_cart_fav"),
             "fav_to_buy": ("fav", "r_fav_buy")}
    cands = []
    for stage, threshold, issue in DROP_OFF_RULES:
        base, rate = bases[stage]
        hit = (F.col(base) > 0) & (F.col(rate) < F.lit(threshold))
        cands.append(F.when(hit, F.struct(
            F.lit(stage).alias("stage"), F.round(rate, 2).alias("rate"),
            F.lit(threshold).alias("threshold"), F.lit(issue).alias("issue"))))
    return c.select("item_id", F.inline(F.array_compact(F.array(*cands))))


def funnel_recommendations(behavior: DataFrame, as_of=None, lookback_days: int = 7,
                           roles: dict | None = None) -> DataFrame:
    """Ordered advice per item; no views short-circuits, empty means 'doing well'."""
    c = _window_counts(behavior, as_of, lookback_days, roles)
    found = F.array_compact(F.array(
        F.when(F.col("r_pv_cart") < 5.0, F.lit(REC_DETAIL_PAGE)),
        F.when((F.col("cart") > 0) & (F.col("r_cart_fav") < 10.0), F.lit(REC_ATTRACTION)),
        F.when((F.col("fav") > 0) & (F.col("r_fav_buy") < 20.0), F.lit(REC_PURCHASE)),
        F.when(F.col("r_pv_buy") < 1.0, F.lit(REC_OVERALL))))
    recs = (F.when(F.col("pv") == 0, F.array(F.lit(REC_NO_EXPOSURE)))
            .when(F.size(found) == 0, F.array(F.lit(REC_GOOD)))
            .otherwise(found))
    return c.select("item_id", recs.alias("recommendations"))


def funnel_conclusion(behavior: DataFrame, as_of=None, lookback_days: int = 7,
                      roles: dict | None = None) -> DataFrame:
    """Conclusion band and sentence from views, buys and the pv->buy rate."""
    c = _window_counts(behavior, as_of, lookback_days, roles)
    r = F.col("r_pv_buy")
    rounded = F.round(r, 2)
    band = (F.when(F.col("pv") == 0, "no_exposure").when(F.col("buy") == 0, "no_purchase")
            .when(r < 1.0, "low").when(r < 3.0, "fair").otherwise("good"))
    text = (F.when(F.col("pv") == 0, F.lit(CONCLUSION_NO_PV))
            .when(F.col("buy") == 0, F.lit(CONCLUSION_NO_BUY))
            .when(r < 1.0, F.format_string(CONCLUSION_LOW, rounded))
            .when(r < 3.0, F.format_string(CONCLUSION_FAIR, rounded))
            .otherwise(F.format_string(CONCLUSION_GOOD, rounded)))
    return c.select("item_id", band.alias("band"), rounded.alias("pv_to_buy_rate"),
                    text.alias("conclusion"))


__all__ = [
    "behavior_norm", "user_item_stage", "item_funnel", "item_funnel_loose",
    "item_funnel_strict", "item_funnel_both", "funnel_rate_check", "items_top",
    "items_opportunity", "item_funnel_window", "funnel_drop_offs",
    "funnel_recommendations", "funnel_conclusion",
]
