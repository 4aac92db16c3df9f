"""Catalog recommender: review statistics, candidates, scores, guardrails,
reasons, commission estimates and ranked recommendations.

Tables: ``items(parent_asin, title, price, average_rating, rating_number,
brand, main_category[, category])`` and ``reviews(parent_asin, user_id,
rating, timestamp_ms, ...)``.  Scoring, guardrails, reasons and commission
are column expressions over all candidates at once (no Python per row);
ranking is a top-N (per-partition heaps, then a bounded merge).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from growthlens.config import CommissionConfig, GuardrailConfig, ScoringConfig
from growthlens.functions.columns import (
    as_ts_column,
    epoch_millis,
    first_text,
    nonfinite_to_null,
    norm_category,
)

# ---------------------------------------------------------------------------
# Fixed values of the analysed application
# ---------------------------------------------------------------------------
TOP_N_MIN, TOP_N_MAX = 1, 100
MS_PER_DAY = 1000 * 60 * 60 * 24
REASON_HIGH_RATING = "评分高（%.1f分）"
REASON_MANY_REVIEWS = "评论多（%d条）"
REASON_SOME_REVIEWS = "评论数适中（%d条）"
REASON_PRICE_BAND = "价格带匹配（$%.2f）"
REASON_PRICE = "价格 $%.2f"
REASON_CATEGORY = "类目匹配（%s）"
REASON_COMPLETE = "商品信息完整"
REASON_RATING = "评分 %.1f"
REASON_REVIEWED = "有 %d 条评价"
REASON_AVAILABLE = "商品可用"
COMMISSION_NOTE = "simulated"
# violation codes, in check order
V_AVG_RATING = "avg_rating_below_min"
V_RATING_COUNT = "rating_count_below_min"
V_REVIEW_COUNT = "review_count_below_min"
V_PRICE_MIN = "price_below_min"
V_PRICE_MAX = "price_above_max"
V_BRAND = "banned_brand"
V_ASIN = "banned_asin"
V_CATEGORY = "banned_category"
V_STALE = "stale_reviews"
V_PRICE_INVALID = "price_invalid"
# message of each violation (fixed texts; value, then bound)
VIOLATION_TEXTS = {
    V_AVG_RATING: "Average rating %s below minimum %s",
    V_RATING_COUNT: "Rating count %s below minimum %s",
    V_REVIEW_COUNT: "Review count %s below minimum %s",
    V_PRICE_MIN: "Price %s below minimum %s",
    V_PRICE_MAX: "Price %s above maximum %s",
    V_PRICE_INVALID: "Invalid price value: %s",
    V_BRAND: "Brand '%s' is banned",
    V_ASIN: "ASIN '%s' is banned",
    V_CATEGORY: "Category '%s' is banned",
    V_STALE: "Last review was %s days ago, exceeds %s days",
}


def _has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def effective_category(df: DataFrame) -> Column:
    """``category`` when present, else ``main_category``."""
    if _has(df, "category"):
        return F.coalesce(F.col("category"), F.col("main_category"))
    return F.col("main_category")


# ---------------------------------------------------------------------------
# #39 / #40 / #41 statistics, candidates, category filter
# ---------------------------------------------------------------------------
def item_stats(reviews: DataFrame) -> DataFrame:
    """Per item: review count, mean review rating, newest review time (ms)."""
    return reviews.groupBy("parent_asin").agg(
        F.count(F.lit(1)).alias("review_cnt"),
        F.avg("rating").alias("avg_rating_review"),
        F.max("timestamp_ms").alias("last_ts_ms"))


def item_candidates(items: DataFrame, stats: DataFrame, q: str | None = None,
                    limit: int | None = None) -> DataFrame:
    """Items with their review statistics.

    Review count defaults to 0 and the review rating falls back to the
    catalog rating; ``q`` is a case-sensitive ``LIKE %q%`` on the title (so
    ``%`` and ``_`` in it act as wildcards).  ``limit`` (optional) keeps the
    first N items by id.
    """
    cand = items
    if q:
        cand = cand.where(F.col("title").like(f"%{q}%"))
    s = stats.select("parent_asin", F.col("review_cnt").alias("_cnt"),
                     F.col("avg_rating_review").alias("_avg"), "last_ts_ms")
    j = cand.join(s, "parent_asin", "left")
    extra = [c for c in items.columns if c != "parent_asin"]
    cols = [F.col("parent_asin")] + [F.col(c) for c in extra if c != "category"]
    cols += [F.coalesce(F.col("_cnt"), F.lit(0)).cast("bigint").alias("review_cnt"),
             F.coalesce(F.col("_avg"), F.col("average_rating")).alias("avg_rating_review"),
             F.col("last_ts_ms"), effective_category(items).alias("category")]
    out = j.select(*cols)
    if limit is not None:
        out = out.orderBy("parent_asin").limit(int(limit))
    return out


def filter_category(candidates: DataFrame, category: str | None) -> DataFrame:
    """Keep candidates whose (category or main category) matches after normalising
    both sides (trimmed, lower case, spaces as underscores)."""
    if not category:
        return candidates
    want = category.strip().lower().replace(" ", "_")
    cat = first_text(F.col("category"), F.col("main_category")) if _has(candidates, "main_category") \
        else F.col("category")
    return candidates.where(norm_category(cat) == F.lit(want))


# ---------------------------------------------------------------------------
# #47 sanitise, #42 score
# ---------------------------------------------------------------------------
def sanitize_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and +/-Infinity in every float / double column become NULL."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = nonfinite_to_null(c)
        cols.append(c.alias(f.name))
    return df.select(*cols)


def _rating_for_score() -> Column:
    a = F.col("avg_rating_review")
    return F.when(a.isNotNull() & (a != 0), a).otherwise(F.col("average_rating"))


def score_column(cfg: ScoringConfig, now_ms: Column) -> Column:
    rating = _rating_for_score()
    span = cfg.rating_max - cfg.rating_min
    rating_norm = F.lit(0.0) if span == 0 else \
        F.when(rating.isNull(), F.lit(0.0)).otherwise((rating - F.lit(cfg.rating_min)) / F.lit(span))
    cnt = F.coalesce(F.col("review_cnt"), F.lit(0))
    max_log = math.log1p(cfg.pop_saturation)
    pop = F.when(cnt <= 0, F.lit(0.0)).otherwise(
        F.least(F.log1p(cnt.cast("double")) / F.lit(max_log), F.lit(1.0)))
    half_life_s = float(cfg.recency_half_life_days * 24 * 60 * 60)
    age_s = (now_ms - F.col("last_ts_ms")).cast("double") / F.lit(1000.0)
    recency = F.when(F.col("last_ts_ms").isNull(), F.lit(0.0)).otherwise(
        F.least(F.pow(F.lit(2.0), -age_s / F.lit(half_life_s)), F.lit(1.0)))
    total = F.lit(cfg.w_rating) * rating_norm + F.lit(cfg.w_pop) * pop + F.lit(cfg.w_recency) * recency
    return F.round(total, 4)


def _now_ms(as_of) -> Column:
    return epoch_millis(as_ts_column(as_of))


def item_score(candidates: DataFrame, cfg: ScoringConfig = ScoringConfig(), as_of=None) -> DataFrame:
    """Weighted rating / popularity / recency score, rounded to 4 places."""
    return candidates.withColumn("score", score_column(cfg, _now_ms(as_of)))


# ---------------------------------------------------------------------------
# #43 - #46 guardrails
# ---------------------------------------------------------------------------
def _in_lower(c: Column, values: tuple[str, ...]) -> Column:
    if not values:
        return F.lit(False)
    return F.lower(c).isin(*[v.lower() for v in values])


def violations_column(df: DataFrame, cfg: GuardrailConfig, now_ms: Column) -> Column:
    """Ordered violation codes (empty array = passes).  NULL inputs never violate."""
    price = F.col("price")
    brand = F.col("brand")
    cat = first_text(F.col("category"), F.col("main_category")) if _has(df, "main_category") \
        else F.col("category")
    asin_hit = F.col("parent_asin").isin(*cfg.banned_asins) if cfg.banned_asins else F.lit(False)
    days_ago = (now_ms - F.col("last_ts_ms")).cast("double") / F.lit(float(MS_PER_DAY))
    checks = [
        (F.col("average_rating") < F.lit(float(cfg.min_avg_rating)), V_AVG_RATING),
        (F.col("rating_number") < F.lit(cfg.min_rating_count), V_RATING_COUNT),
        (F.col("review_cnt") < F.lit(cfg.min_review_count), V_REVIEW_COUNT),
        (price < F.lit(float(cfg.price_min)), V_PRICE_MIN),
        (price > F.lit(float(cfg.price_max)), V_PRICE_MAX),
        ((F.coalesce(brand, F.lit("")) != "") & _in_lower(brand, cfg.banned_brands), V_BRAND),
        (asin_hit, V_ASIN),
        ((F.coalesce(cat, F.lit("")) != "") & _in_lower(cat, cfg.banned_categories), V_CATEGORY),
        (days_ago > F.lit(float(cfg.max_days_since_last_review)), V_STALE),
    ]
    return F.array_compact(F.array(*[F.when(cond, F.lit(code)) for cond, code in checks]))


def guardrail_violations(candidates: DataFrame, cfg: GuardrailConfig = GuardrailConfig(),
                         as_of=None) -> DataFrame:
    return candidates.withColumn("violations", violations_column(candidates, cfg, _now_ms(as_of)))


def guardrail_findings(candidates: DataFrame, cfg: GuardrailConfig = GuardrailConfig(), as_of=None,
                       price_text: str | None = None) -> DataFrame:
    """(parent_asin, seq, code, value, bound, message): one row per violation, in check order, with the offending
    value and the bound it breaks.

    ``price_text`` names a column with the price as it was written: text there that is no price is a violation too
    (the parsed price is NULL then and breaks no bound).
    """
    now_ms = _now_ms(as_of)
    category = first_text(F.col("category"), F.col("main_category")) if _has(candidates, "main_category") else F.col("category")
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    days = (now_ms - F.col("last_ts_ms")).cast("double") / F.lit(float(MS_PER_DAY))
    shown = {
        V_AVG_RATING: (two(F.col("average_rating").cast("double")), cfg.min_avg_rating),
        V_RATING_COUNT: (F.col("rating_number").cast("string"), cfg.min_rating_count),
        V_REVIEW_COUNT: (F.col("review_cnt").cast("string"), cfg.min_review_count),
        V_PRICE_MIN: (two(F.col("price")), cfg.price_min), V_PRICE_MAX: (two(F.col("price")), cfg.price_max),
        V_BRAND: (F.col("brand"), None), V_ASIN: (F.col("parent_asin"), None), V_CATEGORY: (category, None),
        V_STALE: (F.format_string("%.0f", F.round(days)), cfg.max_days_since_last_review),
    }

    def row(code: str, value: Column, bound) -> Column:
        text = F.format_string(VIOLATION_TEXTS[code], value, *([] if bound is None else [F.lit(str(bound))]))
        return F.struct(F.lit(code).alias("code"), value.alias("value"), F.lit(None if bound is None else str(bound)).cast("string").alias("bound"), text.alias("message"))
    found = violations_column(candidates, cfg, now_ms)
    told = F.transform(found, lambda v: F.coalesce(*(F.when(v == code, row(code, *how)) for code, how in shown.items())))
    if price_text is not None:
        bad = F.col("price").isNull() & F.col(price_text).isNotNull()
        told = F.concat(told, F.when(bad, F.array(row(V_PRICE_INVALID, F.col(price_text).cast("string"), None))).otherwise(F.slice(told, 1, 0)))
    return candidates.select("parent_asin", F.posexplode(told).alias("at", "v")).select(
        "parent_asin", (F.col("at") + 1).alias("seq"), "v.code", "v.value", "v.bound", "v.message")


def guardrail_pass(candidates: DataFrame, cfg: GuardrailConfig = GuardrailConfig(),
                   as_of=None) -> DataFrame:
    checked = guardrail_violations(candidates, cfg, as_of)
    return checked.where(F.size("violations") == 0).drop("violations")


def guardrail_stats(candidates: DataFrame, cfg: GuardrailConfig = GuardrailConfig(),
                    as_of=None) -> DataFrame:
    """Items per violation code."""
    checked = guardrail_violations(candidates, cfg, as_of)
    return checked.select(F.explode("violations").alias("violation")) \
        .groupBy("violation").agg(F.count(F.lit(1)).alias("items"))


def guardrail_price_override(candidates: DataFrame, cfg: GuardrailConfig = GuardrailConfig(),
                             price_min: float | None = None, price_max: float | None = None,
                             as_of=None) -> DataFrame:
    """Passing items with request price bounds replacing the configured ones."""
    return guardrail_pass(candidates, cfg.override_price_range(price_min, price_max), as_of)


# ---------------------------------------------------------------------------
# #48 reasons, #49 commission
# ---------------------------------------------------------------------------
def _append(arr: Column, value: Column) -> Column:
    return F.concat(arr, F.array(value))


def reasons_column(df: DataFrame) -> Column:
    rating = _rating_for_score()
    total = F.greatest(F.col("review_cnt"), F.col("rating_number"))
    price = F.col("price")
    cat = first_text(F.col("category"), F.col("main_category")) if _has(df, "main_category") \
        else F.col("category")
    base = F.array_compact(F.array(
        F.when(rating >= 4.0, F.format_string(REASON_HIGH_RATING, F.round(rating, 1))),
        F.when(total >= 50, F.format_string(REASON_MANY_REVIEWS, total))
         .when(total >= 10, F.format_string(REASON_SOME_REVIEWS, total)),
        F.when(price.isNotNull(),
               F.when(price.between(10, 100), F.format_string(REASON_PRICE_BAND, F.round(price, 2)))
               .otherwise(F.format_string(REASON_PRICE, F.round(price, 2))))))
    with_cat = F.when(F.coalesce(cat, F.lit("")) != "",
                      F.when(F.size(base) < 3, _append(base, F.format_string(REASON_CATEGORY, cat)))
                      .otherwise(base)).otherwise(base)
    filled = F.when(F.size(with_cat) == 0, F.array(F.lit(REASON_COMPLETE))).otherwise(with_cat)
    fallback = (F.when(rating.isNotNull(), F.format_string(REASON_RATING, F.round(rating, 1)))
                .when(total > 0, F.format_string(REASON_REVIEWED, total))
                .otherwise(F.lit(REASON_AVAILABLE)))
    padded = F.when(F.size(filled) == 1, _append(filled, fallback)).otherwise(filled)
    return F.slice(padded, 1, 3)


def item_reasons(candidates: DataFrame) -> DataFrame:
    """Two or three reasons per item, by priority: rating, reviews, price, category."""
    return candidates.withColumn("reasons", reasons_column(candidates))


def commission_columns(df: DataFrame, cfg: CommissionConfig) -> tuple[Column, Column]:
    price = F.col("price")
    cat = first_text(F.col("category"), F.col("main_category")) if _has(df, "main_category") \
        else F.col("category")
    default = F.lit(float(cfg.default_rate))
    rate: Column | None = None
    if cfg.category_rates:
        m = F.create_map(*[x for k, v in cfg.category_rates.items()
                           for x in (F.lit(k), F.lit(float(v)))])
        rate = F.element_at(m, cat)
    ranges = None
    for pr in cfg.price_range_rates:
        hit = (price >= F.lit(float(pr.min_price))) & (price < F.lit(float(pr.max_price)))
        ranges = F.when(hit, F.lit(float(pr.rate))) if ranges is None \
            else ranges.when(hit, F.lit(float(pr.rate)))
    parts = [c for c in (rate, ranges) if c is not None] + [default]
    chosen = F.coalesce(*parts) if len(parts) > 1 else default
    rate_col = F.when(price.isNull(), default).otherwise(chosen)
    amount = F.when(price.isNull(), F.lit(0.0)).otherwise(F.round(price * rate_col, 2))
    return rate_col, amount


def item_commission(candidates: DataFrame, cfg: CommissionConfig = CommissionConfig()) -> DataFrame:
    """Rate by category, else first matching price band, else default; amount rounded to cents."""
    rate, amount = commission_columns(candidates, cfg)
    return candidates.select("*", rate.alias("commission_rate"),
                             amount.alias("estimated_commission"),
                             F.lit(COMMISSION_NOTE).alias("commission_note"))


# ---------------------------------------------------------------------------
# #50 / #51 recommendation
# ---------------------------------------------------------------------------
def _checked_candidates(items, reviews, q, category, price_min, price_max, scoring, guard, as_of):
    stats = item_stats(reviews)
    cands = filter_category(item_candidates(items, stats, q, scoring.max_candidates), category)
    cands = sanitize_nonfinite(cands)
    now_ms = _now_ms(as_of)
    g = guard.override_price_range(price_min, price_max)
    return cands.select("*", score_column(scoring, now_ms).alias("score"),
                        violations_column(cands, g, now_ms).alias("violations"))


def recommend_top_n(items: DataFrame, reviews: DataFrame, q: str | None = None,
                    category: str | None = None, price_min: float | None = None,
                    price_max: float | None = None, top_n: int = 10,
                    scoring: ScoringConfig = ScoringConfig(),
                    guard: GuardrailConfig = GuardrailConfig(),
                    commission: CommissionConfig = CommissionConfig(),
                    as_of=None) -> DataFrame:
    """Score, guard, explain and price every candidate; return the best ``top_n``."""
    if not TOP_N_MIN <= int(top_n) <= TOP_N_MAX:
        raise ValueError(f"top_n must be in [{TOP_N_MIN}, {TOP_N_MAX}]")
    checked = _checked_candidates(items, reviews, q, category, price_min, price_max,
                                  scoring, guard, as_of)
    passed = checked.where(F.size("violations") == 0).drop("violations")
    top = passed.orderBy(F.col("score").desc(), F.col("parent_asin").asc()).limit(int(top_n))
    rate, amount = commission_columns(top, commission)
    return top.select("parent_asin", "title", "price", "average_rating", "rating_number",
                      "review_cnt", "avg_rating_review", "category", "score",
                      reasons_column(top).alias("reasons"), rate.alias("commission_rate"),
                      amount.alias("estimated_commission"),
                      F.lit(COMMISSION_NOTE).alias("commission_note"))


def recommend_summary(items: DataFrame, reviews: DataFrame, q: str | None = None,
                      category: str | None = None, price_min: float | None = None,
                      price_max: float | None = None, top_n: int = 10,
                      scoring: ScoringConfig = ScoringConfig(),
                      guard: GuardrailConfig = GuardrailConfig(), as_of=None) -> DataFrame:
    """Candidates, passed and returned counts of one recommendation request."""
    checked = _checked_candidates(items, reviews, q, category, price_min, price_max,
                                  scoring, guard, as_of)
    agg = checked.agg(F.count(F.lit(1)).alias("candidates"),
                      F.count_if(F.size("violations") == 0).alias("passed"))
    return agg.withColumn("returned", F.least(F.col("passed"), F.lit(int(top_n)).cast("bigint")))


# ---------------------------------------------------------------------------
# #52 - #54 catalog inspection
# ---------------------------------------------------------------------------
def catalog_counts(items: DataFrame, reviews: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Row counts of items, reviews and item statistics."""
    stats = item_stats(reviews) if stats is None else stats
    parts = [df.select(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("rows"))
             for name, df in (("items", items), ("reviews", reviews), ("item_stats", stats))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def top_items_by_stats(items: DataFrame, stats: DataFrame, limit: int = 10) -> DataFrame:
    """Most reviewed items (missing statistics count as 0), then by catalog rating."""
    j = items.join(stats.select("parent_asin", "review_cnt"), "parent_asin", "left")
    cnt = F.coalesce(F.col("review_cnt"), F.lit(0)).cast("bigint")
    return (j.select("parent_asin", "title", "price", "average_rating", cnt.alias("review_cnt"))
            .orderBy(F.col("review_cnt").desc(), F.col("average_rating").desc_nulls_last(),
                     F.col("parent_asin").asc()).limit(int(limit)))


def top_items_by_reviews(items: DataFrame, reviews: DataFrame, limit: int = 10) -> DataFrame:
    """Top items by joined review rows, grouped by id, title, price and rating.

    Reviews are counted per item before the join (one row per item instead
    of one per review); duplicate catalog rows multiply the count exactly as
    the row-level join would.
    """
    per_item = reviews.groupBy("parent_asin").agg(F.count("parent_asin").alias("_reviews"))
    grouped = items.groupBy("parent_asin", "title", "price", "average_rating").agg(
        F.count(F.lit(1)).alias("_copies"))
    j = grouped.join(per_item, "parent_asin", "left")
    cnt = (F.col("_copies") * F.coalesce(F.col("_reviews"), F.lit(0))).cast("bigint")
    return (j.select("parent_asin", "title", "price", "average_rating", cnt.alias("review_cnt"))
            .orderBy(F.col("review_cnt").desc(), F.col("average_rating").desc_nulls_last(),
                     F.col("parent_asin").asc()).limit(int(limit)))
