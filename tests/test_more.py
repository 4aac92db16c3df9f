"""As-of rates, title search, many requests, sketches and window comparison on hand-made data."""

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from growthlens.operators import asof, search, sketches, trends
from growthlens.operators import recommend as RC

D = dt.date(2024, 1, 1)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- as-of join -----------------------------------------------------------------------------------
ORDERS, RULES = "id long, merchant_id long, ordered_at timestamp_ntz", "id long, merchant_id long, effective_from date, effective_to date, commission_rate decimal(5,4)"


def _rates(orders, rules):
    out = {}
    for i, m, at in orders:
        began = [r for r in rules if m is not None and at is not None and r[1] == m and r[2] is not None and r[2] <= at.date()]
        last = max(began, key=lambda r: (r[2], r[0]), default=None)
        holds = last is not None and (last[3] is None or at.date() <= last[3])
        out[i] = (last[0] if holds else None, float(last[4]) if holds else 0.1)
    return out


@pytest.mark.parametrize("bucket_days", [1, 7, 10_000])
def test_rate_in_force_matches_a_scan_of_all_rules(spark, bucket_days):
    from decimal import Decimal
    rng = random.Random(bucket_days)
    day = lambda: D + dt.timedelta(rng.randrange(-40, 40))
    rules = [(i, rng.choice([1, 1, 1, 2, 3, None]), rng.choice([day(), day(), day(), None]), rng.choice([None, day()]), Decimal(i % 30) / 100) for i in range(80)]
    orders = [(i, rng.choice([1, 1, 1, 1, 2, 3, 4, None]), rng.choice([dt.datetime.combine(day(), dt.time(rng.randrange(24))), None] + [dt.datetime.combine(day(), dt.time())] * 8))
              for i in range(400)]
    got = asof.commission_rate_as_of(spark.createDataFrame(orders, ORDERS), spark.createDataFrame(rules, RULES), bucket_seconds=bucket_days * asof.DAY)
    assert {r.order_id: (r.rule_id, float(r.commission_rate)) for r in got.collect()} == _rates(orders, rules)


def test_as_of_join_edges_and_plan(spark):
    orders, rules = spark.createDataFrame([], ORDERS), spark.createDataFrame([], RULES)
    assert asof.commission_rate_as_of(orders, rules).count() == 0
    one = spark.createDataFrame([(1, 1, dt.datetime(2024, 1, 1))] * 2, ORDERS)
    got = asof.commission_rate_as_of(one, rules)
    assert [(r.rule_id, float(r.commission_rate)) for r in got.collect()] == [(None, 0.1)] * 2
    plan = _plan(got)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    with pytest.raises(ValueError):
        asof.as_of_join(orders, rules, ["merchant_id"], "ordered_at", "effective_from", ["id"], ["id"])


# --- title search ---------------------------------------------------------------------------------
def _like(title, q):
    rx, i = "", 0
    while i < len(q):
        if q[i] == "\\":
            i += 1
            rx += re.escape(q[i])
        else:
            rx += {"%": ".*", "_": "."}.get(q[i], re.escape(q[i]))
        i += 1
    return re.search(rx, title, re.S) is not None


TITLES = ["red ring", "Red Ring", "blue rings & things", "a", "ab", "", None, "100% wool", "under_score", "back\\slash", "日本語の本", "red ring", "x" * 500, "ring"]
PATTERNS = ["", "r", "ri", "ring", "R_n", "%", "_", "__", "red%ng", "e%r_n", "100\\%", "r\\_s", "k\\\\s", "日本", "の", "zzz", "nope%r", "x" * 40, "a", None, "ring", "100\\% w"]


def test_search_equals_like_for_every_pattern(spark):
    items = spark.createDataFrame([(f"i{k}", t, k) for k, t in enumerate(TITLES)], "parent_asin string, title string, gram int")
    patterns = spark.createDataFrame(list(enumerate(PATTERNS)), "pattern_id int, q string")
    got = sorted((r.pattern_id, r.parent_asin) for r in search.title_search(items, patterns).collect())
    assert got == sorted((p, f"i{k}") for p, q in enumerate(PATTERNS) for k, t in enumerate(TITLES) if q is not None and t is not None and _like(t, q))


def test_search_reads_a_stored_index_and_empty_tables(spark, tmp_path):
    items = spark.createDataFrame([("a", "red ring"), ("b", "blue")], "parent_asin string, title string")
    search.title_postings(items).write.parquet(str(tmp_path / "postings"))
    patterns = spark.createDataFrame([(1, "ring")], "pattern_id int, q string")
    found = search.title_search(items, patterns, spark.read.parquet(str(tmp_path / "postings")))
    assert [tuple(r) for r in found.collect()] == [(1, "a")]
    assert search.title_search(items.limit(0), patterns).count() == 0 and search.title_search(items, patterns.limit(0)).count() == 0
    assert "CartesianProduct" not in _plan(found) and "BroadcastNestedLoopJoin" not in _plan(found)


# --- many requests --------------------------------------------------------------------------------
def test_many_requests_equal_one_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(search, "PRICE_BUCKET", 7.0)
    rng = random.Random(3)
    words = ["red", "ring", "blue", "cap"]
    items = [(f"i{k:03}", " ".join(rng.sample(words, 2)), rng.choice([None, float("nan"), float(rng.randrange(-5, 60))]), rng.choice([None, 4.5, 3.0]), rng.randrange(100),
              "b", rng.choice(["Home Goods", "toys", None])) for k in range(150)]
    items = spark.createDataFrame(items, "parent_asin string, title string, price double, average_rating double, rating_number long, brand string, main_category string")
    reviews = spark.createDataFrame([(f"i{rng.randrange(150):03}", float(rng.randrange(1, 6)), 10**12) for _ in range(500)], "parent_asin string, rating double, timestamp_ms long")
    asked = [(k, rng.choice([None, "", "re", "ring", "r%d", "zz"]), rng.choice([None, "home_goods", " Toys ", "none"]), rng.choice([None, 0.0, 7.0, 13.5]),
              rng.choice([None, 14.0, 30.0, 5.0]), rng.choice([None, 1, 7, 100, 500, -3])) for k in range(60)]
    schema = "request_id int, q string, category string, price_min double, price_max double, top_n int"
    as_of = dt.datetime(2024, 1, 1)
    got = {}
    for r in search.recommend_many(items, reviews, spark.createDataFrame(asked, schema), as_of=as_of).collect():
        got.setdefault(r.request_id, []).append((r.rank, r.parent_asin, r.score))
    checked = RC.sanitize_nonfinite(RC.item_candidates(items, RC.item_stats(reviews)))
    scored = RC.guardrail_pass(RC.item_score(checked, as_of=as_of), as_of=as_of).collect()
    norm = lambda c: (c or "").strip().lower().replace(" ", "_")
    for k, q, category, low, high, n in asked:
        fit = [r for r in scored if (not q or _like(r.title, q)) and (not category or norm(r.main_category) == norm(category))
               and (r.price is None or (0.0 if low is None else low) <= r.price <= (float("inf") if high is None else high))]
        best = sorted((-r.score, r.parent_asin) for r in fit)[: max(1, min(100, 10 if n is None else n))]
        assert sorted(got.get(k, [])) == [(i + 1, a, -s) for i, (s, a) in enumerate(best)], (k, q, category, low, high, n)


def test_a_request_reads_a_few_rows_of_each_tree_level(spark, monkeypatch):
    items = [(f"i{k:04}", "red ring" if k % 2 else "blue cap", k % 30 / 4 if k % 50 else None, 4.0, k % 70, "b", "c") for k in range(1500)]
    items = spark.createDataFrame(items, "parent_asin string, title string, price double, average_rating double, rating_number long, brand string, main_category string")
    reviews = spark.createDataFrame([], "parent_asin string, rating double, timestamp_ms long")
    asked = [(k, "ring" if k % 2 else None, None, k % 7 * 0.3, 5.0 + k % 5 * 0.4, 2) for k in range(70)]
    cut, seen = search._best, {}

    def counted(rows, group, limit):
        seen[tuple(group)] = rows.count()
        return cut(rows, group, limit)
    monkeypatch.setattr(search, "_best", counted)
    schema = "request_id int, q string, category string, price_min double, price_max double, top_n int"
    got = search.recommend_many(items, reviews, spark.createDataFrame(asked, schema), as_of=dt.datetime(2024, 1, 1))
    # two rows each of at most two nodes on five levels and of the items without a price
    assert got.count() == 140 and max(n for group, n in seen.items() if "request_id" in group or "_low" in group) <= 70 * 2 * 11


def test_many_requests_cut_before_the_shuffle(spark):
    items = spark.createDataFrame([("a", "t", 1.0, 4.0, 3, "b", "c")], "parent_asin string, title string, price double, average_rating double, rating_number long, brand string, main_category string")
    reviews = spark.createDataFrame([], "parent_asin string, rating double, timestamp_ms long")
    asked = spark.createDataFrame([(1, None, None, None, None, 5)], "request_id int, q string, category string, price_min double, price_max double, top_n int")
    plan = _plan(search.recommend_many(items, reviews, asked, as_of=dt.datetime(2024, 1, 1)))
    assert "WindowGroupLimit" in plan and "Partial" in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


# --- sketches -------------------------------------------------------------------------------------
def test_window_of_sketches_matches_the_log_within_its_error(spark, tmp_path):
    rows = spark.range(200_000).select((F.col("id") % 30).cast("int").alias("n"), (F.col("id") % 3).alias("item_id"), (F.col("id") * 7 % 50_021).alias("user_id"),
                                       (F.col("id") % 1000).cast("double").alias("value"))
    log = rows.select(F.date_add(F.lit(D), F.col("n")).alias("day"), "item_id", "user_id", "value")
    sketches.daily_sketches(log).write.parquet(str(tmp_path / "days"))
    stored = spark.read.parquet(str(tmp_path / "days"))
    assert stored.count() == 30  # the items' remainders follow the days', so each day holds one item
    told = {r.item_id: r for r in sketches.window_estimates(stored, D + dt.timedelta(29), 20).collect()}
    recent = log.where(F.col("day") > F.lit(D + dt.timedelta(9)))
    for r in recent.groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("u"), F.percentile("value", 0.5).alias("m")).collect():
        assert told[r.item_id].events == r.n and abs(told[r.item_id].users - r.u) <= 0.065 * r.u and abs(told[r.item_id].q50 - r.m) <= 20


def test_sketches_of_nulls_and_empty_windows(spark):
    log = spark.createDataFrame([(D, 1, None, None), (D, 1, 5, None), (None, 1, 6, 1.0), (D, None, 6, 1.0)], "day date, item_id long, user_id long, value double")
    got = sketches.window_estimates(sketches.daily_sketches(log), D, 7).collect()
    assert [tuple(r) for r in got] == [(1, 2, 1, None, None)]
    assert sketches.window_estimates(sketches.daily_sketches(log), D - dt.timedelta(1), 7).count() == 0


# --- window comparison ----------------------------------------------------------------------------
def test_compared_windows_shuffle_facts_only(spark):
    rollup = spark.createDataFrame([(1, dt.date(2024, 1, 1), 3)], "entity_id int, day date, orders long")
    plan = _plan(trends.compared_windows(rollup, "orders", dt.date(2024, 3, 1)))
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_compared_windows_match_plain_sums(spark):
    rng = random.Random(2)
    facts = [(e, dt.datetime.combine(D + dt.timedelta(rng.randrange(60)), dt.time(3))) for e in (1, 1, 1, 2, 3) for _ in range(25)] + [(None, dt.datetime(2024, 1, 1)), (1, None)]
    as_of = D + dt.timedelta(55)
    rollup = trends.daily_rollup(spark.createDataFrame(facts, "m long, at timestamp_ntz"), "m", "at", orders=F.count("*"))
    got = {(r.entity_id, r.day): (r.value, r.previous, r.trailing_mean, r.change) for r in trends.compared_windows(rollup, "orders", as_of).collect()}
    want = {}
    for e in (1, 2, 3):
        days = [(t.date() - D).days for m, t in facts if m == e and t is not None]
        for n in range(min(days), 56):
            total = lambda a, b: float(sum(a <= d <= b for d in days))
            value, age = total(n - 6, n), n - min(days)
            previous = total(n - 13, n - 7) if age >= 13 else None
            want[e, D + dt.timedelta(n)] = (value, previous, total(n - 34, n - 7) * 7 / 28 if age >= 34 else None, value / previous - 1 if previous else None)
    assert got == want


def test_fall_against_the_week_before_is_told_even_if_orders_stop(spark):
    facts = [(1, dt.datetime(2024, 1, 1 + d)) for d in range(14)] + [(2, dt.datetime(2024, 1, 1 + d)) for d in range(21)]
    rollup = trends.daily_rollup(spark.createDataFrame(facts, "m long, at timestamp_ntz"), "m", "at", orders=F.count("*"))
    got = trends.alert_against_previous(rollup, "orders", dt.date(2024, 1, 21)).collect()
    assert [(r.entity_id, r.value, r.previous, r.change) for r in got] == [(1, 0.0, 7.0, -1.0)]
    assert trends.compared_windows(rollup.limit(0), "orders", dt.date(2024, 1, 21)).count() == 0


# --- guardrail findings ---------------------------------------------------------------------------
def test_findings_tell_value_and_bound(spark):
    from growthlens.config import GuardrailConfig
    rows = [("a", None, "n/a", 2.345, 3, 0, "Acme", "Toys", None), ("b", 120.5, "120.5", 4.0, 50, 9, "ok", "Books", 0), ("c", 5.0, "5", None, None, 9, None, None, None)]
    items = spark.createDataFrame(rows, "parent_asin string, price double, price_raw string, average_rating double, rating_number long, review_cnt long, "
                                        "brand string, category string, last_ts_ms long")
    cfg = GuardrailConfig(min_avg_rating=3.5, min_rating_count=10, price_max=100.0, banned_brands=("acme",), max_days_since_last_review=30)
    got = RC.guardrail_findings(items, cfg, as_of=dt.datetime(1970, 2, 10), price_text="price_raw").orderBy("parent_asin", "seq").collect()
    assert [(r.parent_asin, r.code, r.message) for r in got] == [
        ("a", RC.V_AVG_RATING, "Average rating 2.35 below minimum 3.5"), ("a", RC.V_RATING_COUNT, "Rating count 3 below minimum 10"),
        ("a", RC.V_BRAND, "Brand 'Acme' is banned"), ("a", RC.V_PRICE_INVALID, "Invalid price value: n/a"),
        ("b", RC.V_PRICE_MAX, "Price 120.50 above maximum 100.0"), ("b", RC.V_STALE, "Last review was 40 days ago, exceeds 30 days")]


# --- KPIs of both entity kinds ------------------------------------------------------------------------
def test_affiliate_metrics_are_both_in_one_pass(spark):
    from growthlens.operators import affiliate as A
    from growthlens.plans import queries_affiliate as QA
    from tests.conftest import SMALL
    t = QA._inputs(spark, SMALL)
    both = A.affiliate_metrics(t["taokes"], t["merchants"], t["clicks"], t["contents"], t["orders"], as_of=t["as_of"])
    apart = QA._tk_metrics(t).unionByName(QA._mc_metrics(t))
    assert both.columns == apart.columns and both.dtypes == apart.dtypes
    assert sorted(map(repr, both.collect())) == sorted(map(repr, apart.collect()))
    scans = lambda df: _plan(df).count("FileScan")
    assert scans(both) < scans(apart)
    with pytest.raises(ValueError):
        A.affiliate_metrics(t["taokes"], t["merchants"], t["clicks"], t["contents"], t["orders"], as_of=t["as_of"], window_days=14)
