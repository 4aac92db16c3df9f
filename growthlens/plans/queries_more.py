"""Registered queries beyond the application's own: as-of rates, many requests, title search, sketches, window comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from growthlens.functions.columns import fetch_scalar
from growthlens.operators import asof, search, sketches, trends
from growthlens.plans import bindings as bd
from growthlens.plans import queries_catalog as QC
from growthlens.plans.bindings import with_ctes
from growthlens.plans.registry import ints_as_double, register

# ---------------------------------------------------------------------------
# rates by the rule in force
# ---------------------------------------------------------------------------
_RULES = ("dated_rules", """SELECT id, merchant_id, CAST(clicked_at AS DATE) AS effective_from,
  CASE WHEN id % 5 <> 0 THEN CAST(clicked_at AS DATE) + CAST(id % 40 AS INTEGER) END AS effective_to, CAST((id % 20 + 5) / 100.0 AS DECIMAL(5,4)) AS commission_rate
FROM aff_clicks""")


def dated_rules(spark, sf_dir):
    """A rule of its merchant from the day of each click on; four in five end within 40 days."""
    day = F.to_date("clicked_at")
    return bd.aff_clicks(spark, sf_dir).select(
        "id", "merchant_id", day.alias("effective_from"), F.when(F.col("id") % 5 != 0, F.date_add(day, (F.col("id") % 40).cast("int"))).alias("effective_to"),
        ((F.col("id") % 20 + 5) / F.lit(100.0)).cast("decimal(5,4)").alias("commission_rate"))


@register("commission_rate_as_of", with_ctes("""SELECT o.id AS order_id, o.merchant_id, CAST(CAST(o.ordered_at AS DATE) AS VARCHAR) AS order_date,
  CAST(CASE WHEN r.effective_to IS NULL OR CAST(o.ordered_at AS DATE) <= r.effective_to THEN r.id END AS DOUBLE) AS rule_id,
  CAST(CASE WHEN r.id IS NOT NULL AND (r.effective_to IS NULL OR CAST(o.ordered_at AS DATE) <= r.effective_to) THEN r.commission_rate ELSE 0.10 END AS DOUBLE)
    AS commission_rate
FROM aff_orders o ASOF LEFT JOIN last_of_day r ON o.merchant_id = r.merchant_id AND CAST(o.ordered_at AS DATE) >= r.effective_from""",
    "aff_orders", "aff_clicks", extra=(_RULES, ("last_of_day", """SELECT * FROM dated_rules
QUALIFY row_number() OVER (PARTITION BY merchant_id, effective_from ORDER BY id DESC) = 1"""))))
def q_commission_rate_as_of(spark, sf_dir):
    return ints_as_double(asof.commission_rate_as_of(bd.aff_orders(spark, sf_dir), dated_rules(spark, sf_dir)), "rule_id")


# ---------------------------------------------------------------------------
# title search and many requests
# ---------------------------------------------------------------------------
_PATTERNS = ("patterns", """SELECT p_partkey AS pattern_id, CASE p_partkey % 8
  WHEN 0 THEN p_name WHEN 1 THEN substr(p_name, 2, 4) WHEN 2 THEN substr(p_name, 1, 2) || '%' || substr(p_name, -3) WHEN 3 THEN substr(p_name, 3, 1)
  WHEN 4 THEN substr(p_name, 1, 3) || '_' || substr(p_name, 5, 3) WHEN 5 THEN upper(p_name) WHEN 6 THEN substr(p_name, -2) WHEN 7 THEN '_' || p_brand END AS q
FROM part WHERE p_partkey % 4 = 0 OR p_partkey % 4 = p_partkey // 4 % 4""")


def title_patterns(spark, sf_dir):
    """Patterns cut from the parts' names, with and without wildcards."""
    k, name = F.col("p_partkey"), F.col("p_name")
    kinds = [name, F.substring(name, 2, 4), F.concat(F.substring(name, 1, 2), F.lit("%"), F.right(name, F.lit(3))), F.substring(name, 3, 1),
             F.concat(F.substring(name, 1, 3), F.lit("_"), F.substring(name, 5, 3)), F.upper(name), F.right(name, F.lit(2)), F.concat(F.lit("_"), F.col("p_brand"))]
    return bd.table(spark, sf_dir, "part").where((k % 4 == 0) | (k % 4 == F.floor(k / 4) % 4)).select(
        k.alias("pattern_id"), F.element_at(F.array(*kinds), (k % 8 + 1).cast("int")).alias("q"))


@register("title_search", with_ctes("""SELECT q, count(*) AS items, CAST(min(parent_asin) AS VARCHAR) AS first_item, CAST(max(parent_asin) AS VARCHAR) AS last_item
FROM (SELECT DISTINCT q FROM patterns) JOIN items ON title LIKE '%' || q || '%' GROUP BY q""", "items", extra=(_PATTERNS,)))
def q_title_search(spark, sf_dir):
    patterns = title_patterns(spark, sf_dir).select("q").distinct().select(F.col("q").alias("pattern_id"), "q")
    found = search.title_search(bd.items(spark, sf_dir), patterns)
    return found.groupBy(F.col("pattern_id").alias("q")).agg(
        F.count("*").alias("items"), F.min("parent_asin").alias("first_item"), F.max("parent_asin").alias("last_item"))


_REQUESTS = ("requests", """SELECT p_partkey AS request_id, CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN substr(p_name, 1, 4) END AS q,
  CASE WHEN p_partkey % 4 < 2 THEN p_type END AS category, CASE WHEN p_partkey % 5 < 2 THEN CAST(p_partkey % 60 AS DOUBLE) END AS price_min,
  CASE WHEN p_partkey % 7 < 3 THEN CAST(p_partkey % 60 + p_size AS DOUBLE) END AS price_max, CAST(p_size AS INTEGER) AS top_n
FROM part WHERE p_size % 5 = 0""")


def requests(spark, sf_dir):
    """A recommendation request for each part of certain sizes."""
    k = F.col("p_partkey")
    return bd.table(spark, sf_dir, "part").where("p_size % 5 = 0").select(
        k.alias("request_id"), F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.substring("p_name", 1, 4)).alias("q"),
        F.when(k % 4 < 2, F.col("p_type")).alias("category"), F.when(k % 5 < 2, (k % 60).cast("double")).alias("price_min"),
        F.when(k % 7 < 3, (k % 60 + F.col("p_size")).cast("double")).alias("price_max"), F.col("p_size").cast("int").alias("top_n"))


_OPEN_GUARD = QC.GUARD.override_price_range(float("-inf"), float("inf"))


@register("recommend_many", with_ctes(f"""SELECT request_id, CAST(row_number() OVER best AS INTEGER) AS rank, parent_asin, title, price, scored.category AS category, score
FROM requests JOIN scored ON (coalesce(q, '') = '' OR title LIKE '%' || q || '%')
  AND (requests.category IS NULL OR lower(replace(trim(requests.category), ' ', '_')) = lower(replace(trim(scored.category), ' ', '_')))
  AND (price IS NULL OR price BETWEEN coalesce(price_min, {QC.GUARD.price_min}) AND coalesce(price_max, {QC.GUARD.price_max}))
WINDOW best AS (PARTITION BY request_id ORDER BY score DESC, parent_asin)
QUALIFY row_number() OVER best <= greatest(1, least(100, top_n))""", *QC._CAT_CTES, extra=(
        _REQUESTS, QC._STATS, QC._ASOF, QC._cand(),
        ("scored", f"SELECT parent_asin, title, price, category, {QC._score_sql()} AS score FROM cand WHERE {QC._violations_sql(_OPEN_GUARD).replace('-inf', "CAST('-inf' AS DOUBLE)")} = ''"))))
def q_recommend_many(spark, sf_dir):
    items, reviews, as_of = QC._cat(spark, sf_dir)
    return search.recommend_many(items, reviews, requests(spark, sf_dir), QC.SCORING, QC.GUARD, as_of)


# ---------------------------------------------------------------------------
# sketches
# ---------------------------------------------------------------------------
SKETCH_DAYS = 30
_VISITS = ("visits", """SELECT CAST(ts AS DATE) AS day, event_id % 20 AS item_id, user_id * 20 + event_id % 977 AS user_id, value FROM events""")


def visits(spark, sf_dir):
    """The event log with twenty items and many visitors each."""
    return bd.table(spark, sf_dir, "events").select(
        F.to_date("ts").alias("day"), (F.col("event_id") % 20).alias("item_id"), (F.col("user_id") * 20 + F.col("event_id") % 977).alias("user_id"), "value")


@register("sketch_rollup", with_ctes("""SELECT CAST(day AS VARCHAR) AS day, item_id, count(*) AS events,
  count(DISTINCT user_id) AS users FROM visits GROUP BY visits.day, item_id""", extra=(_VISITS,)))
def q_sketch_rollup(spark, sf_dir):
    """The daily rows; a day's visitors of an item are few enough here for their sketch to be exact."""
    rows = sketches.daily_sketches(visits(spark, sf_dir))
    return rows.select("day", "item_id", "events", F.hll_sketch_estimate("users").alias("users"))


@register("sketch_window", with_ctes(f"""SELECT item_id, count(*) AS events, true AS users_within, true AS median_within, true AS high_within
FROM visits WHERE day > (SELECT max(day) FROM visits) - {SKETCH_DAYS} GROUP BY item_id""", extra=(_VISITS,)))
def q_sketch_window(spark, sf_dir):
    """A 30-day window from 30 rows an item, and whether each estimate lies within its stated error of the exact figure."""
    log = visits(spark, sf_dir)
    as_of = fetch_scalar(log.select(F.max("day")))
    told = sketches.window_estimates(sketches.daily_sketches(log), as_of, SKETCH_DAYS)
    recent = log.where((F.col("day") > F.date_sub(F.lit(as_of).cast("date"), SKETCH_DAYS)))
    exact = recent.groupBy("item_id").agg(F.countDistinct("user_id").alias("n_users"))
    ranks = recent.join(told.select("item_id", "q50", "q95"), "item_id").groupBy("item_id").agg(
        *(f(F.when(F.col("value") < F.col(q), 1.0).otherwise(0.0) if low else F.when(F.col("value") <= F.col(q), 1.0).otherwise(0.0)).alias(f"{q}_{'low' if low else 'high'}")
          for q in ("q50", "q95") for low in (True, False) for f in (F.avg,)))
    # four standard errors of the distinct count; two per cent of rank
    near = lambda q, r: (F.col(f"{q}_low") <= r + 0.02) & (F.col(f"{q}_high") >= r - 0.02)
    return told.join(exact, "item_id").join(ranks, "item_id").select(
        "item_id", "events", (F.abs(F.col("users") - F.col("n_users")) <= 0.065 * F.col("n_users") + 1).alias("users_within"),
        near("q50", 0.5).alias("median_within"), near("q95", 0.95).alias("high_within"))


# ---------------------------------------------------------------------------
# windows against the ones before
# ---------------------------------------------------------------------------
_TREND = (
    ("rollup", """SELECT merchant_id AS entity_id, CAST(ordered_at AS DATE) AS day, count(*) AS orders FROM aff_orders GROUP BY 1, 2"""),
    ("calendar", """SELECT entity_id, CAST(unnest(generate_series(min(day), (SELECT as_of FROM aff_asof), INTERVAL 1 DAY)) AS DATE) AS day FROM rollup GROUP BY entity_id"""),
    ("every_day", """SELECT entity_id, day, coalesce(orders, 0) AS orders, min(day) OVER (PARTITION BY entity_id) AS first
FROM calendar LEFT JOIN rollup USING (entity_id, day)"""),
    ("compared", """SELECT entity_id, day, CAST(sum(orders) OVER (w RANGE BETWEEN INTERVAL 6 DAYS PRECEDING AND CURRENT ROW) AS DOUBLE) AS value,
  CASE WHEN day - first >= 13 THEN CAST(sum(orders) OVER (w RANGE BETWEEN INTERVAL 13 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING) AS DOUBLE) END AS previous,
  CASE WHEN day - first >= 34 THEN CAST(sum(orders) OVER (w RANGE BETWEEN INTERVAL 34 DAYS PRECEDING AND INTERVAL 7 DAYS PRECEDING) AS DOUBLE) * 7 / 28 END AS trailing_mean
FROM every_day WINDOW w AS (PARTITION BY entity_id ORDER BY day)"""))
_CHANGED = """SELECT entity_id, CAST(day AS VARCHAR) AS day, value, previous, trailing_mean,
  CASE WHEN previous <> 0 THEN value / previous - 1 END AS change FROM compared"""


def _order_days(spark, sf_dir):
    return trends.daily_rollup(bd.aff_orders(spark, sf_dir), "merchant_id", "ordered_at", orders=F.count("*"))


@register("compared_windows", with_ctes(_CHANGED, "aff_orders", "aff_asof", extra=_TREND))
def q_compared_windows(spark, sf_dir):
    return trends.compared_windows(_order_days(spark, sf_dir), "orders", bd.aff_as_of(spark, sf_dir))


@register("alert_against_previous", with_ctes(f"""SELECT * FROM ({_CHANGED}) WHERE day = (SELECT CAST(as_of AS VARCHAR) FROM aff_asof) AND previous >= 1 AND change <= -0.3""",
    "aff_orders", "aff_asof", extra=_TREND))
def q_alert_against_previous(spark, sf_dir):
    return trends.alert_against_previous(_order_days(spark, sf_dir), "orders", bd.aff_as_of(spark, sf_dir))
