"""Hand-made frames for the semantic edges of the operators (brute-force expectations)."""

import datetime as dt
import math
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from growthlens.config import AlertConfig, CommissionConfig, GuardrailConfig, PriceRangeRate, ScoringConfig
from growthlens.operators import affiliate as A
from growthlens.operators import behavior as B
from growthlens.operators import funnel as FN
from growthlens.operators import recommend as RC
from growthlens.operators import rules as R
from growthlens.sources import behavior_logs as BL
from growthlens.sources import catalog_lines as CL
from growthlens.sources import sinks as SK

D = dt.datetime
SCHEMA = "user_id long, item_id long, action string, ts timestamp_ntz"


def _beh(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


# ---------------------------------------------------------------------------
# lifecycle and retention
# ---------------------------------------------------------------------------
def test_lifecycle_window_and_else_branch(spark):
    anchor = D(2024, 3, 31, 12)
    rows = [
        (1, 1, "pv", anchor - dt.timedelta(days=40)), (1, 1, "pv", anchor),   # new (window effect)
        (2, 1, "pv", anchor - dt.timedelta(days=2)), (2, 1, "pv", anchor),    # dormant, not active
        (3, 1, "pv", anchor - dt.timedelta(days=1)), (3, 1, "pv", anchor - dt.timedelta(days=2)),
        (3, 1, "pv", anchor),                                                # active (3 days)
        (4, 1, "pv", anchor - dt.timedelta(days=7)),                         # warm (boundary)
        (5, 1, "pv", anchor - dt.timedelta(days=8)),                         # dormant
        (6, 1, "pv", anchor - dt.timedelta(days=31)),                        # outside window
    ]
    got = {r.user_id: r.segment for r in B.user_lifecycle(_beh(spark, rows)).collect()}
    assert got == {1: "new", 2: "dormant", 3: "active", 4: "warm", 5: "dormant"}
    segs = B.lifecycle_segments(_beh(spark, rows)).collect()
    assert sum(r.users for r in segs) == 5
    assert math.isclose(sum(r.share for r in segs), 1.0)


def test_d1_latest_after_gap_day_is_zero(spark):
    rows = [(1, 1, "pv", D(2024, 1, 1)), (1, 1, "pv", D(2024, 1, 2)),
            (2, 1, "pv", D(2024, 1, 3)),   # day 4 missing
            (3, 1, "pv", D(2024, 1, 5))]
    by_day = {r.day: (r.active_users, r.retained_users) for r in B.d1_retention_by_day(_beh(spark, rows)).collect()}
    assert by_day[dt.date(2024, 1, 1)] == (1, 1)
    assert by_day[dt.date(2024, 1, 3)] == (1, 0)
    latest = B.d1_retention_latest(_beh(spark, rows)).collect()
    assert latest[0].day == dt.date(2024, 1, 3) and latest[0].rate == 0.0


def test_repurchase_bounds(spark):
    t0 = D(2024, 1, 1, 10)
    rows = [
        (1, 1, "buy", t0), (1, 2, "buy", t0),                                   # same ts: no repeat
        (2, 1, "buy", t0), (2, 1, "buy", t0 + dt.timedelta(days=7)),             # exactly +7d: repeat
        (3, 1, "buy", t0), (3, 1, "buy", t0 + dt.timedelta(days=7, seconds=1)),  # too late
        (4, 1, "4", t0), (4, 1, "BUY", t0 + dt.timedelta(days=1)),               # code / case
        (5, 1, "pv", t0),
    ]
    r = B.repurchase_7d(_beh(spark, rows)).collect()[0]
    assert (r.buyers, r.repurchasers_7d) == (4, 2)
    assert r.rate == 0.5


def test_segment_users_cap_and_unknown_segment(spark):
    anchor = D(2024, 3, 31)
    rows = [(u, 1, "pv", anchor - dt.timedelta(days=3)) for u in range(10)] + [(99, 1, "pv", anchor)]
    got = [r.user_id for r in B.segment_users(_beh(spark, rows), "nonsense", limit=3).collect()]
    assert got == [0, 1, 2]
    assert B.segment_users(_beh(spark, rows), "warm").count() == 10


def test_behavior_counts_normalisation(spark):
    df = spark.createDataFrame([(1, " PV "), (2, "1"), (3, "fav"), (4, "4"), (5, "9"), (6, None)],
                               "user_id long, behavior string")
    got = {r.action: r.cnt for r in B.behavior_counts(df).collect()}
    assert got == {"pv": 2, "fav": 1, "cart": 0, "buy": 1}


# ---------------------------------------------------------------------------
# funnels
# ---------------------------------------------------------------------------
def test_loose_vs_strict(spark):
    t = D(2024, 1, 1)
    s = dt.timedelta(seconds=1)
    rows = [
        (1, 1, "pv", t), (1, 1, "fav", t + s), (1, 1, "cart", t + 2 * s), (1, 1, "buy", t + 3 * s),
        (2, 1, "fav", t), (2, 1, "pv", t + s), (2, 1, "cart", t + 2 * s),        # fav before pv
        (3, 1, "pv", t), (3, 1, "cart", t + s), (3, 1, "fav", t + 2 * s),        # cart before fav
        (4, 1, "pv", t), (4, 1, "fav", t),                                       # same second
        (5, 2, "fav", t),                                                        # no pv at all
    ]
    stage = FN.user_item_stage(FN.behavior_norm(_beh(spark, rows)))
    loose = {r.item_id: r for r in FN.item_funnel_loose(stage).collect()}
    strict = {r.item_id: r for r in FN.item_funnel_strict(stage).collect()}
    assert (loose[1].pv, loose[1].fav, loose[1].cart, loose[1].buy) == (4, 3, 3, 1)
    assert (strict[1].pv, strict[1].fav, strict[1].cart, strict[1].buy) == (4, 2, 1, 1)
    for a in ("fav", "cart", "buy"):
        assert getattr(strict[1], a) <= getattr(loose[1], a)
    assert loose[2].pv == 0 and loose[2].pv_to_buy_rate is None and loose[2].fav_to_cart_rate is None
    # the fav->cart numerator ignores the view, so it may exceed 1 (kept as in the application)
    assert loose[1].fav_to_cart_rate == 2 / 3


def test_items_top_order_and_nulls(spark):
    funnel = spark.createDataFrame(
        [(1, 10, 1, 1, 1, 0.1), (2, 20, 2, 2, 2, 0.1), (3, 0, 0, 0, 0, None), (4, 5, 0, 0, 1, 0.2)],
        "item_id long, pv long, fav long, cart long, buy long, pv_to_buy_rate double")
    top = [r.item_id for r in FN.items_top(funnel, limit=10).collect()]
    assert top == [4, 2, 1, 3]
    assert FN.items_top(funnel, limit=10).collect()[-1].pv_to_buy_rate == 0.0
    opp = [r.item_id for r in FN.items_opportunity(funnel, limit=10, min_pv=5).collect()]
    assert opp == [2, 1, 4]


def test_window_funnel_rules(spark):
    now = D(2024, 1, 8)
    rows = [(1, 7, "pv", now - dt.timedelta(days=1))] * 100 + [(1, 7, "cart", now)] * 2 + \
           [(1, 7, "fav", now)] * 1 + [(1, 7, "buy", now - dt.timedelta(days=8))] + \
           [(1, 8, "cart", now)]
    df = _beh(spark, rows)
    win = {r.item_id: r for r in FN.item_funnel_window(df, as_of=now).collect()}
    assert (win[7].pv, win[7].cart, win[7].fav, win[7].buy) == (100, 2, 1, 0)
    assert win[7].pv_to_cart_rate == 2.0 and win[7].cart_to_fav_rate == 50.0
    drops = {(r.item_id, r.stage) for r in FN.funnel_drop_offs(df, as_of=now).collect()}
    # item 8 has a cart but no fav: cart->fav 0 % is a drop-off (base non-zero)
    assert drops == {(7, "pv_to_cart"), (7, "fav_to_buy"), (8, "cart_to_fav")}
    recs = {r.item_id: r.recommendations for r in FN.funnel_recommendations(df, as_of=now).collect()}
    assert recs[8] == [FN.REC_NO_EXPOSURE]
    assert recs[7] == [FN.REC_DETAIL_PAGE, FN.REC_PURCHASE, FN.REC_OVERALL]
    concl = {r.item_id: r.band for r in FN.funnel_conclusion(df, as_of=now).collect()}
    assert concl == {7: "no_purchase", 8: "no_exposure"}
    with pytest.raises(ValueError):
        FN.item_funnel_window(df, as_of=now, lookback_days=91)


# ---------------------------------------------------------------------------
# recommender
# ---------------------------------------------------------------------------
ITEMS = ("parent_asin string, title string, price double, average_rating double, rating_number long, "
         "brand string, main_category string")


def test_score_guardrails_sanitize(spark):
    nan = float("nan")
    items = spark.createDataFrame([
        ("a", "t", 10.0, None, 50, "BRAND#2", "ECONOMY"),
        ("b", "t", nan, 0.0, None, "x", "Promo"),
        ("c", "t", 100.01, 4.5, 9, "", None),
        ("d", "t", None, nan, 10, None, "toys"),
    ], ITEMS)
    reviews = spark.createDataFrame([("a", 5.0, 1000), ("a", 3.0, 2000), ("c", 0.0, 3000)],
                                    "parent_asin string, rating double, timestamp_ms long")
    cands = RC.sanitize_nonfinite(RC.item_candidates(items, RC.item_stats(reviews)))
    rows = {r.parent_asin: r for r in cands.collect()}
    assert rows["b"].price is None and rows["d"].average_rating is None
    guard = GuardrailConfig(min_avg_rating=3.5, min_rating_count=10, price_min=0, price_max=100,
                            banned_brands=("Brand#2",), banned_categories=("economy",))
    v = {r.parent_asin: r.violations for r in RC.guardrail_violations(cands, guard, as_of=D(1970, 1, 2)).collect()}
    assert v["a"] == [RC.V_BRAND, RC.V_CATEGORY]
    assert v["b"] == [RC.V_AVG_RATING]           # rating 0 < 3.5; NULL count and price never violate
    assert v["c"] == [RC.V_RATING_COUNT, RC.V_PRICE_MAX]
    assert v["d"] == []
    sc = {r.parent_asin: r.score for r in RC.item_score(cands, ScoringConfig(), as_of=D(1970, 1, 1)).collect()}
    # a: review mean 4.0 -> 0.75; 2 reviews; newest review 2 s old
    exp_a = round(0.4 * 0.75 + 0.4 * min(math.log1p(2) / math.log1p(10000), 1) +
                  0.2 * min(2 ** (-(0 - 2000) / 1000 / (180 * 86400)), 1), 4)
    assert sc["a"] == exp_a
    assert sc["d"] == 0.0                          # every part missing
    # c: review mean 0.0 falls back to the catalog rating 4.5
    assert sc["c"] == round(0.4 * (4.5 - 1) / 4 + 0.4 * math.log1p(1) / math.log1p(10000) + 0.2 * 1.0, 4)
    passed = RC.guardrail_pass(cands, guard)
    assert passed.count() <= cands.count()


def test_reason_bands(spark):
    items = spark.createDataFrame([
        ("p1", "t", 10.0, 4.0, 9, "b", "Cat"),
        ("p2", "t", 100.0, 3.0, 10, "b", None),
        ("p3", "t", 100.01, 3.0, 49, "b", "Cat"),
        ("p4", "t", None, None, 50, "b", None),
        ("p5", "t", None, None, 0, "b", None),
    ], ITEMS)
    cands = RC.item_candidates(items, RC.item_stats(spark.createDataFrame(
        [], "parent_asin string, rating double, timestamp_ms long")))
    got = {r.parent_asin: r.reasons for r in RC.item_reasons(cands).collect()}
    assert got["p1"] == ["评分高（4.0分）", "价格带匹配（$10.00）", "类目匹配（Cat）"]
    assert got["p2"] == ["评论数适中（10条）", "价格带匹配（$100.00）"]
    assert got["p3"] == ["评论数适中（49条）", "价格 $100.01", "类目匹配（Cat）"]
    assert got["p4"] == ["评论多（50条）", "有 50 条评价"]
    assert got["p5"] == ["商品信息完整", "商品可用"]


def test_commission_order(spark):
    items = spark.createDataFrame([
        ("a", "t", 10.0, 4.0, 1, "b", "Books"), ("b", "t", 10.0, 4.0, 1, "b", "Toys"),
        ("c", "t", 70.0, 4.0, 1, "b", "Toys"), ("d", "t", None, 4.0, 1, "b", "Books"),
    ], ITEMS)
    cfg = CommissionConfig(default_rate=0.1, category_rates={"Books": 0.2},
                           price_range_rates=(PriceRangeRate(0, 20, 0.05), PriceRangeRate(10, 100, 0.3)))
    cands = RC.item_candidates(items, RC.item_stats(spark.createDataFrame(
        [], "parent_asin string, rating double, timestamp_ms long")))
    got = {r.parent_asin: (r.commission_rate, r.estimated_commission)
           for r in RC.item_commission(cands, cfg).collect()}
    assert got == {"a": (0.2, 2.0), "b": (0.05, 0.5), "c": (0.3, 21.0), "d": (0.1, 0.0)}


def test_recommend_summary_invariant(spark):
    items = spark.createDataFrame([(str(i), f"ring {i}", float(i), 4.0, 20, "b", "c") for i in range(30)], ITEMS)
    reviews = spark.createDataFrame([(str(i % 7), 5.0, 1000 * i) for i in range(50)],
                                    "parent_asin string, rating double, timestamp_ms long")
    guard = GuardrailConfig(price_min=5, price_max=25)
    s = RC.recommend_summary(items, reviews, top_n=10, guard=guard, as_of=D(1970, 1, 2)).collect()[0]
    assert (s.candidates, s.passed, s.returned) == (30, 21, 10)
    top = RC.recommend_top_n(items, reviews, top_n=10, guard=guard, as_of=D(1970, 1, 2)).collect()
    assert len(top) == 10 and all(5 <= r.price <= 25 for r in top)
    assert [r.score for r in top] == sorted([r.score for r in top], reverse=True)


# ---------------------------------------------------------------------------
# affiliate windows and rules
# ---------------------------------------------------------------------------
ORDERS = ("id long, taoke_id long, merchant_id long, product_id long, click_id long, "
          "order_amount decimal(10,2), commission_amount decimal(10,2), status string, ordered_at timestamp_ntz")


def test_kpi_inclusive_vs_alert_half_open(spark):
    as_of = dt.date(2024, 1, 8)
    orders = spark.createDataFrame([
        (1, 1, 1, 1, 11, Decimal(100), Decimal(10), "paid", D(2024, 1, 1, 5)),        # as_of - 7
        (2, 1, 1, 1, 12, Decimal(100), Decimal(10), "refunded", D(2024, 1, 8, 23)),   # as_of
        (3, 1, 1, 1, 13, Decimal(100), Decimal(10), "paid", D(2024, 1, 9)),           # as_of + 1
    ], ORDERS)
    clicks = spark.createDataFrame([(11, 1, 1, 1, 1, D(2024, 1, 1)), (12, 1, 1, 1, 1, D(2024, 1, 8))],
                                   "id long, taoke_id long, content_id long, product_id long, merchant_id long, "
                                   "clicked_at timestamp_ntz")
    contents = spark.createDataFrame([(1, 1, 1, "video", D(2024, 1, 2))],
                                     "id long, taoke_id long, merchant_id long, content_type string, "
                                     "created_at timestamp_ntz")
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    m = {r.entity_id: r for r in A.taoke_metrics(dim, clicks, contents, orders, as_of=as_of).collect()}
    assert (m[1].orders, m[1].refunds, m[1].clicks, m[1].impressions) == (2, 1, 2, 1)
    assert float(m[1].gmv) == 100.0 and m[1].cvr == 100.0 and m[1].ctr == 200.0 and m[1].epc == 50.0
    assert (m[2].orders, m[2].clicks, m[2].cvr, m[2].epc) == (0, 0, 0.0, 0.0)
    # the alert window [as_of - 7, as_of) holds only order 1
    alerts = A.alert_refund_spike(orders, as_of=as_of, min_orders=0, max_rate=-1.0).collect()
    assert [(a.entity_id, a.volume, a.metric_value) for a in alerts] == [(1, 1, 0.0)]
    cvr = A.alert_cvr_drop(orders, clicks, as_of=as_of, min_clicks=0, max_cvr=200.0).collect()
    assert [(a.entity_id, a.volume) for a in cvr] == [(1, 1)]
    assert A.alert_cvr_drop(orders, clicks, as_of=as_of).count() == 0      # defaults cannot fire
    with pytest.raises(ValueError):
        A.merchant_metrics(dim, clicks, orders, as_of=as_of, window_days=14)
    assert AlertConfig().lookback_days == 7


def test_rules_and_opportunities(spark):
    metrics = spark.createDataFrame([
        ("taoke", 1, 1.5, 40.0, 12.0, 25.0, 3, 100, 1000.0),
        ("merchant", 2, 5.0, 70.0, 0.0, 16.0, 0, 10, 0.0),
    ], "entity_type string, entity_id long, cvr double, epc double, refund_rate double, "
       "commission_rate double, orders long, clicks long, gmv double")
    ins = [(r.entity_id, r.seq, r.title) for r in R.diagnosis_insights(metrics).orderBy("entity_id", "seq").collect()]
    assert ins == [(1, 1, "转化率偏低"), (1, 2, "平均订单价值偏低"), (1, 3, "订单量稳定")]
    risks = [(r.entity_id, r.impact) for r in R.diagnosis_risks(metrics).orderBy("entity_id", "seq").collect()]
    assert risks == [(1, "high"), (1, "medium")]
    acts = [r.action for r in R.diagnosis_next_actions(metrics).orderBy("seq").collect()]
    assert acts == [R.ACTION_CVR, R.ACTION_REFUND]
    opps = {(r.entity_id, r.opp_id): r.estimated_gain for r in R.opportunities(metrics).collect()}
    assert opps == {(1, "opp_1"): 100 * 0.01 * 40.0, (1, "opp_2"): 100 * (60 - 40.0),
                    (1, "opp_3"): 1000.0 * (12.0 - 5) / 100, (2, "opp_4"): None}


def test_effective_commission_rate_ties(spark):
    rules = spark.createDataFrame([
        (1, 1, 1, 1, 0.05, dt.date(2024, 1, 1)), (2, 1, 1, 1, 0.07, dt.date(2024, 1, 1)),
        (3, 1, 1, 1, 0.09, dt.date(2023, 1, 1)),
    ], "id long, merchant_id long, product_id long, taoke_id long, commission_rate double, effective_from date")
    rules = rules.withColumn("commission_rate", F.col("commission_rate").cast("decimal(5,4)"))
    orders = spark.createDataFrame([(10, 1, 1, 1), (11, 2, 1, 1)],
                                   "id long, merchant_id long, product_id long, taoke_id long")
    got = {r.order_id: float(r.commission_rate) for r in A.effective_commission_rate(orders, rules).collect()}
    assert got == {10: 0.07, 11: 0.10}


# ---------------------------------------------------------------------------
# ingest
# ---------------------------------------------------------------------------
def test_meta_and_review_limits_brute_force(spark):
    meta = [(i, f'{{"parent_asin": "a{i}", "price": "$1,2{i}9.50", "categories": ["x"]}}') for i in range(20)]
    meta[3] = (3, "   ")
    meta[5] = (5, "{broken")
    lines = spark.createDataFrame(meta, "line_no long, value string")
    items = CL.parse_item_meta(lines, "electronics", meta_limit=10)
    got = sorted(r.parent_asin for r in items.collect())
    # first 10 non-blank lines: 0..12 without 3; the broken one is skipped
    assert got == sorted(f"a{i}" for i in [0, 1, 2, 4, 6, 7, 8, 9, 10])
    row = items.where("parent_asin = 'a1'").collect()[0]
    assert row.price == 1219.5 and row.category == "Electronics" and row.categories_json == '["x"]'
    revs = [(i, f'{{"asin": "a{i % 12}", "overall": 4, "unixReviewTime": {i}}}') for i in range(30)]
    rl = spark.createDataFrame(revs, "line_no long, value string")
    kept = CL.reviews_for_items(rl, items, "x", scan_limit=20, reviews_limit=5).collect()
    expected = [i for i in range(20) if f"a{i % 12}" in got][:5]
    assert sorted(r.line_no for r in kept) == expected
    assert all(r.rating == 4.0 for r in kept)


def test_behavior_csv_tsv_without_header(spark):
    lines = spark.createDataFrame([
        (0, "1\t10\t5\tpv\t1700000000.9"), (1, "2\t11\t5\tBUY\t1700000001"),
        (2, "3\t12\t5\tclick\t1700000002"), (3, "4\t13\t5"), (4, "5\t14\t5\tcart\tnan"),
    ], "line_no long, value string")
    got = [(r.user_id, r.behavior, r.timestamp) for r in BL.import_behavior_csv(lines).orderBy("user_id").collect()]
    assert got == [("1", "pv", 1700000000), ("2", "buy", 1700000001)]
    capped = BL.import_behavior_csv(lines, limit=1).collect()
    assert [r.user_id for r in capped] == ["1"]


def test_union_files_first_rows_and_missing_column(spark):
    cols = "user_id string, item_id string, behavior_type string, user_geohash string, item_category string, time string"
    f1 = spark.createDataFrame([(str(i), "1", str(i % 5), "", "c", "t") for i in range(6)], cols) \
        .withColumn("_line", F.monotonically_increasing_id())
    out = BL.union_behavior_files([f1], nrows_each=4).collect()
    assert [r.behavior_type for r in out] == ["0", "pv", "fav", "cart"]
    with pytest.raises(ValueError):
        BL.union_behavior_files([f1.drop("time")])


def test_upsert_incoming_wins(spark):
    cur = spark.createDataFrame([("a", "old"), ("b", "keep")], "parent_asin string, title string")
    inc = spark.createDataFrame([("a", "new"), ("c", "added")], "parent_asin string, title string")
    got = {r.parent_asin: r.title for r in SK.upsert_items(cur, inc).collect()}
    assert got == {"a": "new", "b": "keep", "c": "added"}


def test_save_funnel_tables_modes(spark, tmp_path):
    t = D(2024, 1, 1)
    rows = [(1, 1, "pv", t), (1, 1, "fav", t), (2, 1, "pv", t), (2, 1, "fav", t + dt.timedelta(seconds=5))]
    stage = FN.user_item_stage(FN.behavior_norm(_beh(spark, rows)))
    written = SK.save_funnel_tables(spark, stage, str(tmp_path / "strict"), mode="strict")
    assert set(written) == {"item_funnel_features_strict"}
    # the default view follows the chosen mode (strict: 1 of 2 users favourited after viewing)
    assert spark.table("item_funnel_features").first().fav == 1
    SK.save_funnel_tables(spark, stage, str(tmp_path / "both"), mode="both")
    both = {(r.strict, r.fav) for r in spark.table("item_funnel_features_both").collect()}
    assert both == {(0, 2), (1, 1)}
    assert spark.table("item_funnel_features_default").first().fav == 2
    with pytest.raises(ValueError):
        SK.save_funnel_tables(spark, stage, str(tmp_path / "no"), mode="everything")


def test_upsert_with_order_column_and_export(spark, tmp_path):
    cur = spark.createDataFrame([("a", "old", 1)], "parent_asin string, title string, v long")
    inc = spark.createDataFrame([("a", "first", 1), ("a", "second", 2)], "parent_asin string, title string, v long")
    got = SK.upsert_items(cur, inc, order_col="v").collect()
    assert [(r.parent_asin, r.title) for r in got] == [("a", "second")]
    anchor = D(2024, 3, 31)
    beh = _beh(spark, [(u, 1, "pv", anchor - dt.timedelta(days=2)) for u in (5, 3, 9)] + [(1, 1, "pv", anchor)])
    path = SK.export_segment_users_csv(spark, beh, str(tmp_path / "users"), "Warm", limit=2)
    assert [r.user_id for r in SK.read_segment_export(spark, path).collect()] == [3, 5]


def test_review_field_fallbacks_follow_python_or(spark):
    lines = spark.createDataFrame([
        (1, '{"parent_asin": "a", "rating": 0, "overall": 0, "user_id": "", "reviewerID": ""}'),
        (2, '{"asin": "b", "overall": "4", "timestamp": 0, "unixReviewTime": 17, "text": "", "reviewText": "t"}'),
        (3, '{"parent_asin": "", "asin": ""}'),
    ], "line_no long, value string")
    got = {r.parent_asin: r for r in CL.parse_reviews(lines, "x").collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].rating == 0.0 and got["a"].user_id == "" and got["a"].timestamp == 0
    assert got["b"].rating == 4.0 and got["b"].timestamp == 17 and got["b"].text == "t"


def test_quoted_csv_fields_and_decimal_numbers(spark):
    lines = spark.createDataFrame([
        (1, '"1","2","3","pv","1511544070"'), (2, "4,5,6,buy,1511544071.5"), (3, '7,"8,9",6,BUY,1511544072'),
        (4, '"a ""b""",1,2,fav,1511544073'), (5, "1,2,3,pv"), (6, ""), (7, "1,2,3,4,1511544074")], "line_no long, value string")
    got = [tuple(r) for r in BL.import_behavior_csv(lines).orderBy("timestamp").collect()]
    assert got == [("1", "2", "pv", 1511544070, "3"), ("4", "5", "buy", 1511544071, "6"), ("7", "8,9", "buy", 1511544072, "6"),
                   ('a "b"', "1", "fav", 1511544073, "2")]
    tabs = spark.createDataFrame([(5, "u\ti\tc\tb\tt"), (6, "1\t2,2\t3\tcart\t9")], "line_no long, value string").repartition(3)
    assert [tuple(r) for r in BL.import_behavior_csv(tabs).collect()] == [("1", "2,2", "cart", 9, "3")]
    raw = spark.createDataFrame([("123.0", "7", "1.0", "", "5.0", "2024-01-02 03")],
                                "user_id string, item_id string, behavior_type string, user_geohash string, item_category string, time string")
    r = BL.rebuild_user_behavior(raw).first()
    assert (r.user_id, r.item_id, r.behavior_type, r.user_geohash, r.item_category) == (123, 7, "pv", None, 5)
    norm = FN.behavior_norm(spark.createDataFrame([(1, 2, 4.0, "1511544070.0")], "user_id long, item_id long, action double, ts string")).first()
    assert (norm.action, norm.ts) == ("buy", 1511544070)


def test_row_limits_need_an_order(spark):
    df = spark.createDataFrame([(1, 1, "1", "", "1", "")], "user_id long, item_id long, behavior_type string, user_geohash string, item_category string, time string")
    with pytest.raises(ValueError):
        BL.union_behavior_files([df], nrows_each=1)
    with pytest.raises(ValueError):
        BL.rebuild_user_behavior(df, limit=1)
    assert BL.union_behavior_files([df, df]).count() == 2


def test_repurchase_of_a_hot_buyer_without_a_join(spark):
    t0 = D(2024, 1, 1)
    rows = [(1, 1, "buy", t0 + dt.timedelta(minutes=k)) for k in range(3000)]
    rows += [(2, 1, "buy", t0), (2, 1, "buy", t0), (3, 1, "buy", t0), (3, 1, "buy", t0 + dt.timedelta(days=7))]
    out = B.repurchase_7d(_beh(spark, rows))
    assert (out.first().buyers, out.first().repurchasers_7d) == (3, 2)
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_upsert_keeps_rows_without_key_and_plans_no_sort(spark):
    cur = spark.createDataFrame([("a", "old"), (None, "x"), (None, "y")], "parent_asin string, title string")
    inc = spark.createDataFrame([("a", "new"), (None, "z")], "parent_asin string, title string")
    out = SK.upsert_items(cur, inc)
    assert sorted(r.title for r in out.collect()) == ["new", "x", "y", "z"]
