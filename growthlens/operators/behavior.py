"""Behavior overview, retention, repurchase and lifecycle segments.

Input is a behavior log with user, item, action and time columns under any of
the accepted names (see ``resolve_columns``).  Every operator computes all
users / days / segments in distributed aggregations; the only value brought to
the driver is the lifecycle anchor day (one scalar).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from growthlens.functions.columns import (
    ACTIONS,
    action_strict,
    fetch_scalar,
    is_buy,
    ntz_literal,
    parse_event_ts,
    project_once,
    ratio_or_null,
    ratio_or_zero,
    resolve_columns,
)

# ---------------------------------------------------------------------------
# Fixed values of the analysed application
# ---------------------------------------------------------------------------
SEGMENTS = ("new", "active", "warm", "dormant")
SEGMENT_LABELS = {"new": "新客", "active": "活跃", "warm": "回访", "dormant": "沉睡"}
SEGMENT_RULES = {
    "new": "新客：first_day == anchor_day（首次出现即锚点日）",
    "active": "活跃：last_day==anchor_day 且 近7天活跃天数>=3",
    "warm": "回访：last_day < anchor_day 且 last_day>=anchor_day-7天",
    "dormant": "沉睡：last_day < anchor_day-7天 且 last_day>=anchor_day-30天",
}

# journey steps: key, from, to, title, tag, detail, default segment, message type
JOURNEY_STEPS = (
    ("pv_fav", "pv", "fav", "浏览→收藏偏低", "建议：提升兴趣",
     "收藏意向弱：用内容场景/对比卖点/达人讲解强化“为什么需要它”，并在详情页增加信任背书与权益提醒。",
     "warm", "pv_low_fav"),
    ("fav_cart", "fav", "cart", "收藏→加购需要推动", "建议：促转",
     "收藏后未加购：用限时券/套装/包邮门槛，配合“对比清单/搭配建议”把用户推到加购。",
     "warm", "fav_drop"),
    ("cart_buy", "cart", "buy", "加购→购买转化尚可（优先做放大）", "建议：放大",
     "对高意向人群做“套装/加价购/阶梯满减”，提升客单；对加购未买做 24h 内触达（券/包邮/评价露出/对比内容）。",
     "warm", "cart_drop"),
)

# lifecycle advice rows: key, title, tag, detail, default segment, message type
ADVICE_D1_UNKNOWN = ("d1_unknown", "次日留存：待计算", "建议：排查",
                     "先确保 user_behavior 导入成功且 timestamp 可解析。", "new", "retention_push")
ADVICE_D1_LOW = ("d1_low", "次日留存偏低", "建议：召回",
                 "对昨日有行为但今日未回访：24h 内券/上新/加购提醒，分层触达。", "warm", "retention_push")
ADVICE_D1_OK = ("d1_ok", "次日留存健康", "建议：放大",
                "把高留存人群做分层：加购&收藏优先触达，推同类新品 + 低门槛权益。", "active", "retention_push")
ADVICE_REP_UNKNOWN = ("rep_unknown", "7日复购：待计算", "建议：补口径",
                      "确保 behavior 可识别 buy（值为 buy 或 4）。", "active", "repurchase_push")
ADVICE_REP_LOW = ("rep_low", "7日复购偏低", "建议：复购",
                  "首购后 3/5/7 天分批触达：复购券 + 组合装/订阅/周期购。", "warm", "repurchase_push")
ADVICE_REP_OK = ("rep_ok", "7日复购不错", "建议：拉升客单",
                 "把复购人群做高客单包：组合购、阶梯满减、订阅/周期购。", "active", "repurchase_push")
ADVICE_MEMBER = ("member_placeholder", "会员运营（占位）", "建议：分层",
                 "Demo 无会员字段；后续接会员/订单表后补“渗透/贡献/拉新转正/沉睡唤醒”。",
                 "dormant", "dormant_wakeup")
D1_LOW_RATE = 0.15
REPURCHASE_LOW_RATE = 0.08

# message types each segment is the default audience for
SEGMENT_MESSAGE_TYPES = {
    "warm": ("pv_low_fav", "fav_drop", "cart_drop", "retention_push", "repurchase_push"),
    "new": ("retention_push",),
    "active": ("retention_push", "repurchase_push"),
    "dormant": ("dormant_wakeup",),
}

_ADVICE_FIELDS = ("key", "title", "tag", "detail", "default_segment", "default_message_type")


# ---------------------------------------------------------------------------
# input shaping
# ---------------------------------------------------------------------------
def behavior_events(behavior: DataFrame, roles: dict | None = None) -> DataFrame:
    """(user_id, item_id?, action?, ts) with the tolerant event time parsed."""
    r = resolve_columns(behavior, roles, required=("user", "ts"))
    cols = [F.col(r["user"]).alias("user_id")]
    if "item" in r:
        cols.append(F.col(r["item"]).alias("item_id"))
    if "action" in r:
        cols.append(F.col(r["action"]).alias("action"))
    cols.append(parse_event_ts(behavior, r["ts"]).alias("ts"))
    return behavior.select(*cols)


def user_day_rollup(behavior: DataFrame, roles: dict | None = None) -> DataFrame:
    """(user_id, d, first_buy, last_buy) per user and day (NULL day: unreadable times), combined map-side.

    Serves distinct users, D1 retention, repurchase and the lifecycle, so one
    pass over the log is enough for all of them.
    """
    ev = behavior_events(behavior, roles)
    bought = F.when(is_buy(F.col("action")), F.col("ts")) if "action" in ev.columns else F.lit(None).cast("timestamp_ntz")
    return ev.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min(bought).alias("first_buy"), F.max(bought).alias("last_buy"))


def _user_days(behavior: DataFrame, roles: dict | None) -> DataFrame:
    ev = behavior_events(behavior, roles)
    return ev.where(F.col("ts").isNotNull()).select("user_id", F.to_date("ts").alias("d"))


# ---------------------------------------------------------------------------
# #17 overview, #18 counts, #19 journey
# ---------------------------------------------------------------------------
def behavior_overview(behavior: DataFrame, funnel: DataFrame | None = None,
                      roles: dict | None = None) -> DataFrame:
    """One row: log rows, exact distinct users and items, funnel-table rows."""
    r = resolve_columns(behavior, roles, required=())
    keys = [F.col(r[k]).alias(k) for k in ("user", "item") if k in r]
    # each (user, item) once, combined map-side; both distinct counts come from this rollup
    pairs = behavior.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    out = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("user_behavior_rows"))
    for k in ("user", "item"):
        number = pairs.groupBy(k).agg(F.lit(1).alias("one")).select(F.count(k)).scalar() if k in r else F.lit(None).cast("bigint")
        out = out.withColumn(f"distinct_{k}s", number)
    funnel_rows = funnel.select(F.count(F.lit(1))).scalar() if funnel is not None \
        else F.lit(0).cast("bigint")
    return out.withColumn("item_funnel_features_rows", funnel_rows)


def _action_totals(behavior: DataFrame, roles: dict | None) -> DataFrame:
    r = resolve_columns(behavior, roles, required=("action",))
    k = action_strict(F.col(r["action"]))
    return behavior.agg(*[F.count_if(k == F.lit(a)).alias(a) for a in ACTIONS])


def action_totals(behavior: DataFrame, roles: dict | None = None) -> DataFrame:
    """One row of event counts per action (pv, fav, cart, buy)."""
    return _action_totals(behavior, roles)


def behavior_counts(behavior: DataFrame, roles: dict | None = None,
                    totals: DataFrame | None = None) -> DataFrame:
    """Rows per action for exactly pv/fav/cart/buy; codes 1..4 and any case accepted."""
    totals = _action_totals(behavior, roles) if totals is None else totals
    pairs = ", ".join(f"'{a}', {a}" for a in ACTIONS)
    return totals.selectExpr(f"stack({len(ACTIONS)}, {pairs}) AS (action, cnt)")


def journey_rates(behavior: DataFrame, roles: dict | None = None,
                  totals: DataFrame | None = None) -> DataFrame:
    """pv->fav, fav->cart, cart->buy event ratios (0 when the base is 0) with advice."""
    totals = _action_totals(behavior, roles) if totals is None else totals
    rows = [F.struct(F.lit(key).alias("key"), F.lit(a).alias("from_action"),
                     F.lit(b).alias("to_action"),
                     ratio_or_zero(F.col(b), F.col(a)).alias("rate"),
                     F.lit(title).alias("title"), F.lit(tag).alias("tag"),
                     F.lit(detail).alias("detail"), F.lit(seg).alias("default_segment"),
                     F.lit(msg).alias("default_message_type"))
            for key, a, b, title, tag, detail, seg, msg in JOURNEY_STEPS]
    return totals.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------------------
# #20 / #21 next-day retention
# ---------------------------------------------------------------------------
def d1_retention_by_day(behavior: DataFrame, roles: dict | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """Per day: active users, users also active the next day, and the rate.

    Each user's set of active days (combined map-side, bounded by the days of
    the log) tells which of them were followed by another; then days are
    counted.  ``rollup`` may be a built ``user_day_rollup``.
    """
    days = _user_days(behavior, roles) if rollup is None else rollup.where("d is not null").select("user_id", "d")
    sets = days.groupBy("user_id").agg(F.collect_set("d").alias("days"))
    each = sets.select(F.explode("days").alias("d"), "days").select(
        "d", F.array_contains("days", F.date_add("d", 1)).cast("int").alias("nxt"))
    by_day = each.groupBy("d").agg(
        F.count(F.lit(1)).alias("active_users"),
        F.sum("nxt").cast("bigint").alias("retained_users"))
    return by_day.select(F.col("d").alias("day"), "active_users", "retained_users",
                         ratio_or_null(F.col("retained_users"), F.col("active_users")).alias("rate"))


def d1_retention_latest(behavior: DataFrame, roles: dict | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """The latest day strictly before the last day (rate 0 after a gap day).

    The last active day is the newest row of the per-day table, so the two
    newest days (a bounded top-2) decide it without another pass.
    """
    top2 = d1_retention_by_day(behavior, roles, rollup).orderBy(F.col("day").desc()).limit(2)
    newest = F.max("day").over(Window.partitionBy())   # over at most two rows
    return top2.withColumn("_newest", newest).where(F.col("day") < F.col("_newest")).drop("_newest")


# ---------------------------------------------------------------------------
# #22 seven-day repurchase
# ---------------------------------------------------------------------------
def repurchase_7d(behavior: DataFrame, roles: dict | None = None, days: int = 7, rollup: DataFrame | None = None) -> DataFrame:
    """Buyers, buyers with another buy in (first, first + 7 days], and the rate.

    No join: buys collapse map-side to the first and last of each user and day,
    so a hot buyer costs one row per day.  A buyer repeats if the first buying
    day holds a later buy, or if the next buying day starts in time.
    """
    if rollup is None:
        ev = behavior_events(behavior, roles)
        buys = ev.where(F.col("ts").isNotNull() & is_buy(F.col("action")))
        per_day = buys.groupBy("user_id", F.to_date("ts").alias("d")).agg(F.min("ts").alias("first_buy"), F.max("ts").alias("last_buy"))
    else:
        per_day = rollup.where("first_buy is not null and user_id is not null")
    two = per_day.where("user_id is not null").groupBy("user_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct("first_buy", "last_buy"))), 1, 2).alias("t"))
    first, second = F.col("t")[0], F.try_element_at("t", F.lit(2))
    until = F.timestamp_add("DAY", F.lit(days), first["first_buy"])
    repeat = ((first["last_buy"] > first["first_buy"]) & (F.lit(days) > 0)) | F.coalesce(second["first_buy"] <= until, F.lit(False))
    out = two.agg(F.count(F.lit(1)).alias("buyers"), F.count_if(repeat).alias("repurchasers_7d"))
    return out.withColumn("rate", ratio_or_null(F.col("repurchasers_7d"), F.col("buyers")))


# ---------------------------------------------------------------------------
# #23 - #27 lifecycle
# ---------------------------------------------------------------------------
def user_lifecycle(behavior: DataFrame, roles: dict | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """Per user active in the 30 days up to the anchor (= last active day): segment.

    The anchor is fetched once as a literal, so the 30-day bound reaches the
    file scan; distinct (user, day) pairs are combined map-side before the
    per-user aggregation, so a hot user costs at most one row per day.
    """
    ev = behavior_events(behavior, roles) if rollup is None else rollup
    # newest event time, then its calendar day (= max of the event days)
    newest = fetch_scalar(ev.select(F.max("ts" if rollup is None else "d")))
    anchor_day = newest.date() if isinstance(newest, _dt.datetime) else newest
    anchor = F.lit(anchor_day).cast("date")
    start = anchor_day - _dt.timedelta(days=30) if anchor_day else None
    if rollup is None:
        # the window bound on the raw time column reaches the file scan as a pushed filter
        pairs = (ev.where(F.col("ts").isNotNull() & (F.col("ts") >= ntz_literal(start)))
                 .select("user_id", F.to_date("ts").alias("d")).distinct())
    else:
        pairs = ev.where(F.col("d") >= F.lit(start).cast("date")).select("user_id", "d")
    agg = pairs.groupBy("user_id").agg(
        F.min("d").alias("first_day"), F.max("d").alias("last_day"),
        F.sum(F.when(F.col("d") >= F.date_sub(anchor, 7), 1).otherwise(0)).cast("bigint").alias("days_7d"),
        F.count(F.lit(1)).alias("active_days_30d"))
    last = F.col("last_day")
    segment = (F.when(F.col("first_day") == anchor, "new")
               .when((last == anchor) & (F.col("days_7d") >= 3), "active")
               .when((last < anchor) & (last >= F.date_sub(anchor, 7)), "warm")
               .otherwise("dormant"))
    return agg.select("user_id", "first_day", "last_day", "days_7d", "active_days_30d",
                      segment.alias("segment"), anchor.alias("anchor_day"))


def _by_segment(texts: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in texts.items() for x in pair]), F.col("segment"))


def lifecycle_segments(behavior: DataFrame, roles: dict | None = None, rollup: DataFrame | None = None) -> DataFrame:
    """Users, share of all users and mean active days per segment."""
    stat = user_lifecycle(behavior, roles, rollup).groupBy("segment").agg(
        F.count(F.lit(1)).alias("users"),
        F.avg("active_days_30d").alias("avg_actions"),
        F.max("anchor_day").alias("anchor_day"))
    # at most four rows reach this window
    total = F.sum("users").over(Window.partitionBy())
    return stat.select("anchor_day", "segment", "users",
                       ratio_or_null(F.col("users"), total).alias("share"),
                       "avg_actions", total.alias("total_users"),
                       _by_segment(SEGMENT_LABELS).alias("segment_label"), _by_segment(SEGMENT_RULES).alias("segment_rule")) \
        .orderBy(F.col("users").desc(), "segment")


def _advice_struct(values: tuple) -> Column:
    return F.struct(*[F.lit(v).alias(n) for v, n in zip(values, _ADVICE_FIELDS)])


def lifecycle_advice(behavior: DataFrame, roles: dict | None = None,
                     repurchase: DataFrame | None = None, d1_latest: DataFrame | None = None) -> DataFrame:
    """Advice rows from the latest D1 rate and the seven-day repurchase rate
    (pass already built ``repurchase`` / ``d1_latest`` frames to share their stages)."""
    rep = repurchase_7d(behavior, roles) if repurchase is None else repurchase
    d1 = d1_retention_latest(behavior, roles) if d1_latest is None else d1_latest
    d1_rate = d1.select("rate").scalar()
    # one evaluation of the D1 subquery, however often the rules refer to it
    base = project_once(rep, [], d1_rate=d1_rate, rep_rate=F.col("rate"))
    d1 = (F.when(F.col("d1_rate").isNull(), _advice_struct(ADVICE_D1_UNKNOWN))
          .when(F.col("d1_rate") < D1_LOW_RATE, _advice_struct(ADVICE_D1_LOW))
          .otherwise(_advice_struct(ADVICE_D1_OK)))
    rp = (F.when(F.col("rep_rate").isNull(), _advice_struct(ADVICE_REP_UNKNOWN))
          .when(F.col("rep_rate") < REPURCHASE_LOW_RATE, _advice_struct(ADVICE_REP_LOW))
          .otherwise(_advice_struct(ADVICE_REP_OK)))
    return base.select(F.inline(F.array(d1, rp, _advice_struct(ADVICE_MEMBER))))


def normalize_segment(segment: str | None) -> str:
    seg = (segment or "").strip().lower()
    return seg if seg in SEGMENTS else "warm"


def segment_users(behavior: DataFrame, segment: str = "warm", limit: int | None = None,
                  roles: dict | None = None) -> DataFrame:
    """User ids of one segment (unknown names mean ``warm``); all of them, or the ``limit`` smallest ids."""
    users = user_lifecycle(behavior, roles).where(F.col("segment") == normalize_segment(segment)).select("user_id")
    return users if limit is None else users.orderBy("user_id").limit(max(1, int(limit)))


def campaign_audience(behavior: DataFrame, roles: dict | None = None) -> DataFrame:
    """Each user with every message type its segment is the default audience for."""
    mapping = F.create_map(*[x for seg, types in SEGMENT_MESSAGE_TYPES.items()
                             for x in (F.lit(seg), F.array(*[F.lit(t) for t in types]))])
    lc = user_lifecycle(behavior, roles)
    return lc.select("user_id", "segment",
                     F.explode(F.element_at(mapping, F.col("segment"))).alias("message_type"))
