"""Affiliate ("taoke") and merchant KPIs, the daily product view, alerts and lookups.

Tables follow the affiliate schema: ``clicks(id, taoke_id, content_id,
product_id, merchant_id, clicked_at)``, ``orders(id, taoke_id, merchant_id,
product_id, click_id, order_amount, commission_amount, status, ordered_at)``,
``contents(id, taoke_id, merchant_id, content_type, created_at)``,
``commission_rules``, ``content_product_map``, ``products`` and the
``merchants`` / ``taokes`` dimensions.  Ids are primary keys.

Each fact table is scanned once per operator and aggregated per entity with
map-side partial aggregation; entity dimensions are joined to the (small)
aggregates, so the cost does not depend on how many entities are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.config import AlertConfig
from growthlens.functions.columns import as_date_column, ratio_or_zero

# ---------------------------------------------------------------------------
# Fixed values of the analysed application
# ---------------------------------------------------------------------------
TAOKE_WINDOWS = (7, 14, 30)
MERCHANT_WINDOWS = (7, 30)
GMV_STATUSES = ("paid", "pending")
REFUNDED = "refunded"
DEFAULT_RULE_RATE = "0.10"
CVR_ALERT_TITLE = "淘客 %s 转化率偏低"
CVR_ALERT_TEXT = "过去 {days} 天 CVR 为 %.2f%%，低于 {bound}%% 阈值"
ALERT_COMPARISON = "阈值 {bound}%"
REFUND_ALERT_TITLE = "商家 %s 退款率异常"
REFUND_ALERT_TEXT = "过去 {days} 天退款率为 %.2f%%，超过 {bound}%% 阈值"


# ---------------------------------------------------------------------------
# helpers
# ---------------------------------------------------------------------------
def _date_between(df: DataFrame, ts_name: str, start: Column, end: Column) -> Column:
    """``date(ts) BETWEEN start AND end`` written on the raw column (pushdown-friendly)."""
    ts = F.col(ts_name)
    dt = df.schema[ts_name].dataType
    if isinstance(dt, T.DateType):
        return (ts >= start) & (ts <= end)
    lo = start.cast(dt.simpleString())
    hi = F.date_add(end, 1).cast(dt.simpleString())
    return (ts >= lo) & (ts < hi)


def _date_half_open(df: DataFrame, ts_name: str, start: Column, end: Column) -> Column:
    """``date(ts) >= start AND date(ts) < end``."""
    ts = F.col(ts_name)
    dt = df.schema[ts_name].dataType
    if isinstance(dt, T.DateType):
        return (ts >= start) & (ts < end)
    return (ts >= start.cast(dt.simpleString())) & (ts < end.cast(dt.simpleString()))


def _money(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("decimal(20,2)")).cast("decimal(20,2)")


def _order_aggs() -> list[Column]:
    status = F.col("status")
    keep = status.isin(*GMV_STATUSES)
    zero = F.lit(0).cast("decimal(10,2)")
    return [F.count("id").alias("orders"),
            F.count_if(status == REFUNDED).alias("refunds"),
            F.sum(F.when(keep, F.col("order_amount")).otherwise(zero)).alias("gmv"),
            F.sum(F.when(keep, F.col("commission_amount")).otherwise(zero)).alias("commission_paid")]


def _rates(with_ctr: bool) -> list[Column]:
    clicks, orders, gmv = F.col("clicks"), F.col("orders"), F.col("gmv").cast("double")
    ctr = F.round(ratio_or_zero(clicks, F.col("impressions"), 100.0), 2) if with_ctr else F.lit(0.0)
    return [
        ctr.alias("ctr"),
        F.round(ratio_or_zero(orders, clicks, 100.0), 2).alias("cvr"),
        F.when(clicks > 0, gmv / clicks.cast("double")).otherwise(F.lit(0.0)).alias("epc"),
        F.round(ratio_or_zero(F.col("refunds"), orders, 100.0), 2).alias("refund_rate"),
        F.round(F.when(gmv > 0, F.col("commission_paid").cast("double") / gmv * F.lit(100.0))
                .otherwise(F.lit(0.0)), 2).alias("commission_rate"),
    ]


def _by_entity(facts: DataFrame, kinds: list[str]):
    """``facts`` grouped by (entity_type, entity_id): each row counts once for each kind of entity, in one pass."""
    entities = [F.struct(F.lit(k).alias("entity_type"), F.col(f"{k}_id").alias("entity_id")) for k in kinds]
    return facts.select("*", F.inline(F.array(*entities))).groupBy("entity_type", "entity_id")


def _entity_metrics(dims: dict[str, DataFrame], clicks: DataFrame, orders: DataFrame,
                    contents: DataFrame | None, as_of, window_days: int) -> DataFrame:
    """KPIs of the entities in ``dims`` (kind -> dimension); ``contents`` count as impressions of affiliates."""
    end = as_date_column(as_of)
    start = F.date_sub(end, int(window_days))
    kinds, on = list(dims), ["entity_type", "entity_id"]
    c = _by_entity(clicks.where(_date_between(clicks, "clicked_at", start, end)), kinds).agg(F.count("id").alias("clicks"))
    o = _by_entity(orders.where(_date_between(orders, "ordered_at", start, end)), kinds).agg(*_order_aggs())
    j = None
    for kind, dim in dims.items():
        base = dim.select(F.lit(kind).alias("entity_type"), F.col("id").alias("entity_id"))
        j = base if j is None else j.unionByName(base)
    j = j.join(c, on, "left").join(o, on, "left")
    if contents is not None:
        imp = _by_entity(contents.where(_date_between(contents, "created_at", start, end)), ["taoke"]).agg(F.count("id").alias("impressions"))
        j = j.join(imp, on, "left")
    impressions = F.lit(0) if contents is None else F.coalesce(F.col("impressions"), F.lit(0))
    filled = j.select(
        *on, impressions.cast("bigint").alias("impressions"),
        F.coalesce(F.col("clicks"), F.lit(0)).cast("bigint").alias("clicks"),
        F.coalesce(F.col("orders"), F.lit(0)).cast("bigint").alias("orders"),
        F.coalesce(F.col("refunds"), F.lit(0)).cast("bigint").alias("refunds"),
        _money(F.col("gmv")).alias("gmv"), _money(F.col("commission_paid")).alias("commission_paid"))
    return filled.select(
        *on, F.lit(f"{int(window_days)}d").alias("window"), start.alias("start_date"), end.alias("end_date"),
        "impressions", "clicks", "orders", "refunds", "gmv", "commission_paid",
        *_rates(with_ctr=contents is not None))


# ---------------------------------------------------------------------------
# #55 / #56 entity KPIs
# ---------------------------------------------------------------------------
def taoke_metrics(taokes: DataFrame, clicks: DataFrame, contents: DataFrame, orders: DataFrame,
                  as_of=None, window_days: int = 7) -> DataFrame:
    """Per affiliate over [as_of - N days, as_of] (both ends inclusive)."""
    if int(window_days) not in TAOKE_WINDOWS:
        raise ValueError(f"window must be one of {TAOKE_WINDOWS}")
    return _entity_metrics({"taoke": taokes}, clicks, orders, contents, as_of, window_days)


def merchant_metrics(merchants: DataFrame, clicks: DataFrame, orders: DataFrame,
                     as_of=None, window_days: int = 7) -> DataFrame:
    """Per merchant; impressions and CTR are not tracked (0)."""
    if int(window_days) not in MERCHANT_WINDOWS:
        raise ValueError(f"window must be one of {MERCHANT_WINDOWS}")
    return _entity_metrics({"merchant": merchants}, clicks, orders, None, as_of, window_days)


def affiliate_metrics(taokes: DataFrame, merchants: DataFrame, clicks: DataFrame, contents: DataFrame, orders: DataFrame,
                      as_of=None, window_days: int = 7) -> DataFrame:
    """``taoke_metrics`` and ``merchant_metrics`` together: each fact table is read and shuffled once for both."""
    if int(window_days) not in set(TAOKE_WINDOWS) & set(MERCHANT_WINDOWS):
        raise ValueError(f"window must be one of {MERCHANT_WINDOWS}")
    return _entity_metrics({"taoke": taokes, "merchant": merchants}, clicks, orders, contents, as_of, window_days)


# ---------------------------------------------------------------------------
# #57 daily product view
# ---------------------------------------------------------------------------
def daily_product_metrics(orders: DataFrame, clicks: DataFrame, contents: DataFrame) -> DataFrame:
    """Per order date x product x merchant x affiliate: contents, clicks, orders, GMV.

    Orders are first combined per (group, click) -- a click determines its
    content -- so the distinct click count becomes a plain count and only the
    content count stays distinct; no multi-way distinct expansion is needed.
    """
    keep = F.col("status").isin(*GMV_STATUSES)
    zero = F.lit(0).cast("decimal(10,2)")
    o = orders.select(F.to_date("ordered_at").alias("metric_date"), "product_id", "merchant_id",
                      "taoke_id", "click_id", F.col("id").alias("order_id"), "status",
                      "order_amount", "commission_amount")
    cl = clicks.select(F.col("id").alias("cl_id"), F.col("content_id").alias("cl_content_id"))
    group = ["metric_date", "product_id", "merchant_id", "taoke_id"]
    per_click = (o.join(cl, o["click_id"] == cl["cl_id"], "left")
                 .groupBy(*group, "cl_id", "cl_content_id").agg(
                     F.count("order_id").alias("orders"),
                     F.count(F.when(F.col("status") == REFUNDED, F.col("order_id"))).alias("refunds"),
                     F.sum(F.when(keep, F.col("order_amount")).otherwise(zero)).alias("gmv"),
                     F.sum(F.when(keep, F.col("commission_amount")).otherwise(zero)).alias("commission_paid")))
    c = contents.select(F.col("id").alias("c_id"))
    with_content = per_click.join(c, per_click["cl_content_id"] == c["c_id"], "left")
    agg = with_content.groupBy(*group).agg(
        F.count_distinct("c_id").alias("impressions"),
        F.count("cl_id").alias("clicks"),
        F.sum("orders").cast("bigint").alias("orders"),
        F.sum("refunds").cast("bigint").alias("refunds"),
        F.sum("gmv").cast("decimal(20,2)").alias("gmv"),
        F.sum("commission_paid").cast("decimal(20,2)").alias("commission_paid"))
    clicks_c = F.col("clicks")
    return agg.select(
        *group, "impressions", "clicks", "orders", "refunds", "gmv", "commission_paid",
        F.when(clicks_c > 0, F.col("orders").cast("double") / clicks_c.cast("double"))
        .otherwise(F.lit(0.0)).alias("cvr"),
        F.when(clicks_c > 0, F.col("gmv").cast("double") / clicks_c.cast("double"))
        .otherwise(F.lit(0.0)).alias("epc"))


# ---------------------------------------------------------------------------
# #58 - #60 alerts
# ---------------------------------------------------------------------------
_ALERT_COLUMNS = ("alert_type", "severity", "entity_type", "entity_id", "metric", "metric_value",
                  "volume", "title", "description", "evidence_value", "comparison", "time_window")


def alert_text(template: str, days: int, bound: float) -> str:
    """A description with the window and threshold that were used."""
    return template.format(days=days, bound=f"{float(bound):g}")


def alert_cvr_drop(orders: DataFrame, clicks: DataFrame, as_of=None,
                   min_clicks: int | None = None, max_cvr: float | None = None,
                   cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Affiliates whose last-7-day orders have > min_clicks matched clicks and CVR < max_cvr.

    The window is [as_of - 7 days, as_of).  Clicks are those joined from the
    orders themselves (so CVR >= 100% whenever every order has a click); the
    thresholds are parameters for that reason.
    """
    min_clicks = cfg.cvr_min_clicks if min_clicks is None else min_clicks
    max_cvr = cfg.cvr_max_pct if max_cvr is None else max_cvr
    end = as_date_column(as_of)
    start = F.date_sub(end, cfg.lookback_days)
    ow = orders.where(_date_half_open(orders, "ordered_at", start, end)).select(
        "id", "taoke_id", "click_id")
    per = ow.groupBy("taoke_id").agg(F.count("id").alias("orders"))
    # inner join: adaptive execution may broadcast the (small) windowed orders
    matched = (ow.join(clicks.select(F.col("id").alias("cid")), ow["click_id"] == F.col("cid"))
               .groupBy("taoke_id").agg(F.count("cid").alias("clicks")))
    j = per.join(matched, "taoke_id", "left").select(
        "taoke_id", "orders", F.coalesce(F.col("clicks"), F.lit(0)).cast("bigint").alias("clicks"))
    cvr = ratio_or_zero(F.col("orders"), F.col("clicks"), 100.0)
    hits = j.where((F.col("clicks") > int(min_clicks)) & (cvr < F.lit(float(max_cvr))))
    return hits.select(
        F.lit("cvr_drop").alias("alert_type"), F.lit("warning").alias("severity"),
        F.lit("taoke").alias("entity_type"), F.col("taoke_id").alias("entity_id"),
        F.lit("CVR").alias("metric"), cvr.alias("metric_value"), F.col("clicks").alias("volume"),
        F.format_string(CVR_ALERT_TITLE, F.col("taoke_id")).alias("title"),
        F.format_string(alert_text(CVR_ALERT_TEXT, cfg.lookback_days, max_cvr), F.round(cvr, 2)).alias("description"),
        F.format_string("%.2f%%", F.round(cvr, 2)).alias("evidence_value"), F.lit(alert_text(ALERT_COMPARISON, 0, max_cvr)).alias("comparison"),
        F.lit(f"{cfg.lookback_days}d").alias("time_window"))


def alert_refund_spike(orders: DataFrame, as_of=None, min_orders: int | None = None,
                       max_rate: float | None = None, cfg: AlertConfig = AlertConfig()) -> DataFrame:
    """Merchants with > min_orders orders in [as_of - 7, as_of) and refund rate > max_rate %."""
    min_orders = cfg.refund_min_orders if min_orders is None else min_orders
    max_rate = cfg.refund_max_pct if max_rate is None else max_rate
    end = as_date_column(as_of)
    start = F.date_sub(end, cfg.lookback_days)
    per = (orders.where(_date_half_open(orders, "ordered_at", start, end))
           .groupBy("merchant_id").agg(F.count("id").alias("total_orders"),
                                        F.count_if(F.col("status") == REFUNDED).alias("refunds")))
    rate = ratio_or_zero(F.col("refunds"), F.col("total_orders"), 100.0)
    hits = per.where((F.col("total_orders") > int(min_orders)) & (rate > F.lit(float(max_rate))))
    return hits.select(
        F.lit("refund_spike").alias("alert_type"), F.lit("critical").alias("severity"),
        F.lit("merchant").alias("entity_type"), F.col("merchant_id").alias("entity_id"),
        F.lit("退款率").alias("metric"), rate.alias("metric_value"),
        F.col("total_orders").alias("volume"),
        F.format_string(REFUND_ALERT_TITLE, F.col("merchant_id")).alias("title"),
        F.format_string(alert_text(REFUND_ALERT_TEXT, cfg.lookback_days, max_rate), F.round(rate, 2)).alias("description"),
        F.format_string("%.2f%%", F.round(rate, 2)).alias("evidence_value"), F.lit(alert_text(ALERT_COMPARISON, 0, max_rate)).alias("comparison"),
        F.lit(f"{cfg.lookback_days}d").alias("time_window"))


def alerts_run(orders: DataFrame, clicks: DataFrame, as_of=None,
               cfg: AlertConfig = AlertConfig(), **overrides) -> DataFrame:
    """Both alert kinds in one frame."""
    cvr = alert_cvr_drop(orders, clicks, as_of, overrides.get("min_clicks"),
                         overrides.get("max_cvr"), cfg)
    ref = alert_refund_spike(orders, as_of, overrides.get("min_orders"),
                             overrides.get("max_rate"), cfg)
    return cvr.select(*_ALERT_COLUMNS).unionByName(ref.select(*_ALERT_COLUMNS))


# ---------------------------------------------------------------------------
# #66 / #67 lookups
# ---------------------------------------------------------------------------
def effective_commission_rate(orders: DataFrame, rules: DataFrame,
                              default_rate: str = DEFAULT_RULE_RATE) -> DataFrame:
    """Each order's commission rate: the latest rule (by effective_from, then id)
    for its (merchant, product, affiliate), else the default rate.

    Latest rule per key is a map-side combined ``max_by``; the order join is
    on the full key, so a hot key is split by adaptive skew-join handling.
    """
    key = ["merchant_id", "product_id", "taoke_id"]
    latest = rules.groupBy(*key).agg(
        F.max_by("commission_rate", F.struct("effective_from", "id")).alias("rule_rate"),
        F.max_by("id", F.struct("effective_from", "id")).alias("rule_id"))
    rate_type = rules.schema["commission_rate"].dataType.simpleString()
    o = orders.select(F.col("id").alias("order_id"), *key)
    return o.join(latest, key, "left").select(
        "order_id", *key, "rule_id",
        F.coalesce(F.col("rule_rate"), F.lit(default_rate).cast(rate_type)).alias("commission_rate"))


def content_products(contents: DataFrame, content_product_map: DataFrame,
                     products: DataFrame) -> DataFrame:
    """Products linked to each content, with the owning merchant."""
    c = contents.select(F.col("id").alias("content_id"), F.col("taoke_id"),
                        F.col("content_type"))
    m = content_product_map.select("content_id", "product_id")
    p = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"),
                        F.col("merchant_id"))
    return c.join(m, "content_id").join(p, "product_id").select(
        "content_id", "taoke_id", "content_type", "product_id", "product_name", "merchant_id")


__all__ = ["taoke_metrics", "merchant_metrics", "daily_product_metrics", "alert_cvr_drop",
           "alert_refund_spike", "alerts_run", "effective_commission_rate", "content_products"]
