"""Column helpers on small hand-made frames."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from growthlens.functions import columns as C


def test_parse_event_ts_layouts(spark):
    df = spark.createDataFrame([("2024-01-05 03",), ("2024-01-05 03:04:05",), ("2024-01-05",),
                                ("bad",), (None,)], "time string")
    got = [r.ts for r in df.select(C.parse_event_ts(df, "time").alias("ts")).collect()]
    assert got == [dt.datetime(2024, 1, 5, 3), dt.datetime(2024, 1, 5, 3, 4, 5),
                   dt.datetime(2024, 1, 5), None, None]
    ep = spark.createDataFrame([(1704067200,)], "t long")
    assert ep.select(C.parse_event_ts(ep, "t").alias("ts")).first().ts == dt.datetime(2024, 1, 1)


def test_epoch_seconds_rounds_half_even(spark):
    df = spark.createDataFrame([(dt.datetime(1970, 1, 1, 0, 0, 2, 500000),),
                                (dt.datetime(1970, 1, 1, 0, 0, 3, 500000),),
                                (dt.datetime(1970, 1, 1, 0, 0, 3, 500001),)], "ts timestamp_ntz")
    assert [r.s for r in df.select(C.epoch_seconds(F.col("ts")).alias("s")).collect()] == [2, 4, 4]


def test_parse_price_and_alias(spark):
    df = spark.createDataFrame([("$1,299.50 - 4",), ("12",), ("N/A",), ("",), (None,), ("from 3.5",)], "p string")
    assert [r.x for r in df.select(C.parse_price(F.col("p")).alias("x")).collect()] == \
        [1299.5, 12.0, None, None, None, 3.5]
    cats = spark.createDataFrame([(" 3c ",), ("3C",), ("electronics",), ("Electronics",), ("Toys ",)], "c string")
    assert [r.x for r in cats.select(C.category_alias(F.col("c")).alias("x")).collect()] == \
        ["Electronics", "Electronics", "Electronics", "Electronics", "Toys"]
    assert [r.x for r in cats.select(C.norm_category(F.lit(" All Beauty ")).alias("x")).collect()][0] == "all_beauty"


def test_action_mappings(spark):
    df = spark.createDataFrame([("1",), ("4",), ("9",), ("PV",), (" cart ",), ("1.5x",), (None,)], "a string")
    row = lambda f: [r.x for r in df.select(f(F.col("a")).alias("x")).collect()]
    assert row(C.action_from_int_or_text) == ["pv", "buy", None, "pv", " cart ", "1.5x", None]
    assert row(C.action_names_or_codes) == ["pv", "buy", "9", "pv", " cart ", "1.5x", None]
    assert row(C.action_strict) == ["pv", "buy", None, "pv", "cart", None, None]
    assert [r.x for r in df.select(C.is_buy(F.col("a")).alias("x")).collect()][:2] == [False, True]


def test_guarded_integer_casts(spark):
    df = spark.createDataFrame([(" 12 ",), ("-3",), ("1e3",), ("abc",), ("99999999999",)], "s string")
    assert [r.x for r in df.select(C.int_or_null(F.col("s")).alias("x")).collect()] == [12, -3, None, None, None]
    assert [r.x for r in df.select(C.long_or_null(F.col("s")).alias("x")).collect()] == \
        [12, -3, None, None, 99999999999]


def test_resolve_columns(spark):
    df = spark.createDataFrame([(1, 2, "pv", 3)], "UserID long, item long, Behavior_Type string, time long")
    r = C.resolve_columns(df)
    assert r == {"user": "UserID", "item": "item", "action": "Behavior_Type", "ts": "time"}
    with pytest.raises(ValueError):
        C.resolve_columns(df.drop("time"))
    assert C.resolve_columns(df, {"ts": "item"})["ts"] == "item"


def test_ratios_and_sanitize(spark):
    df = spark.createDataFrame([(1, 0), (1, 4)], "a long, b long")
    assert [r.x for r in df.select(C.ratio_or_null(F.col("a"), F.col("b")).alias("x")).collect()] == [None, 0.25]
    assert [r.x for r in df.select(C.ratio_or_zero(F.col("a"), F.col("b"), 100.0).alias("x")).collect()] == [0.0, 25.0]
    nan = spark.createDataFrame([(float("nan"),), (float("inf"),), (1.5,)], "v double")
    assert [r.x for r in nan.select(C.nonfinite_to_null(F.col("v")).alias("x")).collect()] == [None, None, 1.5]


def test_project_once_and_fetch_scalar(spark):
    df = spark.createDataFrame([(1, "a,b"), (2, "c")], "k long, s string")
    out = C.project_once(df, ["k"], parts=F.split("s", ","))
    assert [(r.k, r.parts) for r in out.collect()] == [(1, ["a", "b"]), (2, ["c"])]
    assert C.fetch_scalar(df.select(F.max("k"))) == 2
    assert C.fetch_scalar(df.where("k > 5").select(F.max("k"))) is None


def test_first_rows_by_histogram_matches_top_n(spark):
    df = spark.range(0, 5000).select((F.col("id") * 7 + 3).alias("line_no"), (F.col("id") % 13).alias("v"))
    df = df.where(F.col("v") != 5)          # gaps in the ordering key
    for n in (1, 17, 999, 2500, 4614, 10000):
        want = sorted(r.line_no for r in df.orderBy("line_no").limit(n).collect())
        got = sorted(r.line_no for r in C.first_rows_by(df, "line_no", n).collect())
        assert got == want, n


def test_first_rows_by_takes_exactly_n_of_repeated_numbers(spark):
    rows = [(k % 7, k // 2 if k % 3 else None) for k in range(60)] + [(3, 9)] * 10 + [(None, 1)]
    df = spark.createDataFrame(rows, "line_no long, v long")
    for n in (1, 5, 20, 45, 69, 70, 71, 500):
        got = [r.line_no for r in C.first_rows_by(df, "line_no", n).collect()]
        want = sorted(k for k, _ in rows if k is not None)[:n]
        assert sorted(got) == want, n
        again = sorted(map(tuple, C.first_rows_by(df.repartition(3), "line_no", n).collect()), key=str)
        assert again == sorted(map(tuple, C.first_rows_by(df, "line_no", n).collect()), key=str)


def test_number_text_reads_like_a_sql_cast(spark):
    import duckdb
    texts = ["1", "1.0", " 2 ", "-3.5", "2.5", "+4", ".5", "7.", "x", "", "1.2.3", "99999999999", "123456789012345678", "1511544070.0"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.i, r.l) for r in df.select(C.int_or_null(F.col("t")).alias("i"), C.long_or_null(F.col("t")).alias("l")).collect()]
    want = [duckdb.execute("SELECT TRY_CAST(? AS INTEGER), TRY_CAST(? AS BIGINT)", [t, t]).fetchone() for t in texts]
    assert got == want
