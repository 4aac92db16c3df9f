"""Test-table bindings: canonical inputs derived from the shared parquet tables.

Each binding exists twice with the same meaning: a DataFrame builder for the
Spark side and a SQL common-table expression for the DuckDB oracle.  Every
binding reads the given tables, so its size grows with them.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from growthlens.functions.columns import epoch_millis, fetch_scalar, ntz_literal


#: added to a part key for items that no review names
UNREVIEWED = 1 << 40


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a test-data folder."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _size(spark, sf_dir, name: str) -> int:
    """Rows of a key table (parquet footers only); keys of other tables are mapped onto them."""
    return max(1, table(spark, sf_dir, name).count())


def _action_case(c: Column) -> Column:
    """Known events by name; any other event keeps its own, unmapped, name."""
    return (F.when(c == "view", "pv").when(c == "click", "fav")
            .when(c == "signup", "cart").when(c == "purchase", "buy").otherwise(c))


def _item_of() -> Column:
    """Ten items for each 65 users, so that items grow with the log while users still meet an item again."""
    group = F.floor(F.col("user_id") / 65).cast("bigint")
    return group * 10 + F.regexp_extract("props", r"([0-9]+)", 1).cast("bigint") % 10


# ---------------------------------------------------------------------------
# behavior
# ---------------------------------------------------------------------------
def behavior(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        (F.col("user_id") * 20 + F.col("event_id") % 20).alias("user_id"),
        _item_of().alias("item_id"),
        _action_case(F.col("event_type")).alias("action"), "ts")


def behavior_dense(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return ev.select(
        "user_id", _item_of().alias("item_id"),
        _action_case(F.col("event_type")).alias("action"), "ts")


def behavior_sparse(spark, sf_dir) -> DataFrame:
    """``behavior`` with rare carts (1 signup in 25) and rare buys (1 purchase in 20);
    the other signups are views and purchases favourites, so conversion falls
    below the funnel thresholds and every drop-off / advice branch occurs."""
    ev = table(spark, sf_dir, "events")
    et, eid = F.col("event_type"), F.col("event_id")
    action = (F.when(et == "view", "pv").when(et == "click", "fav")
              .when(et == "signup", F.when(eid % 25 == 0, "cart").otherwise("pv"))
              .when(et == "purchase", F.when(eid % 20 == 0, "buy").otherwise("fav")).otherwise(et))
    return ev.select(
        (F.col("user_id") * 20 + eid % 20).alias("user_id"),
        _item_of().alias("item_id"), action.alias("action"), "ts")


def behavior_raw(spark, sf_dir) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    et, eid = F.col("event_type"), F.col("event_id")
    code = (F.when(et == "view", "1").when(et == "click", "2").when(et == "signup", "3")
            .when(et == "purchase", "4").otherwise("9"))
    btype = (F.when(eid % 3 == 0, code)
             .when(eid % 3 == 1, F.upper(_action_case(et)))
             .otherwise(_action_case(et)))
    ts_text = F.col("ts").cast("string")
    time = (F.when(eid % 4 == 0, F.substring(ts_text, 1, 13))
            .when(eid % 4 == 1, F.substring(ts_text, 1, 19))
            .when(eid % 4 == 2, F.substring(ts_text, 1, 10)).otherwise(F.lit("bad")))
    return ev.select(
        "user_id", _item_of().alias("item_id"), btype.alias("behavior_type"),
        F.when(eid % 2 == 0, F.lit("")).otherwise(F.lit("g")).alias("user_geohash"),
        (eid % 50).cast("string").alias("item_category"), time.alias("time"))


# ---------------------------------------------------------------------------
# catalog
# ---------------------------------------------------------------------------
def items(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    # each fifth part a second time under an id that has no reviews
    ids = F.when(k % 5 == 0, F.array(k, k + UNREVIEWED)).otherwise(F.array(k))
    return p.select("*", F.explode(ids).alias("_id")).select(
        F.col("_id").cast("string").alias("parent_asin"), F.col("p_name").alias("title"),
        F.when(k % 17 == 0, F.lit(None)).otherwise((k % 120).cast("double") + 0.99).alias("price"),
        F.when(k % 13 == 0, F.lit(None))
        .otherwise(F.lit(1.0) + (F.col("p_size") % 9).cast("double") / 2).alias("average_rating"),
        (k % 60).cast("bigint").alias("rating_number"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("main_category"))


def reviews(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_partkey").cast("string").alias("parent_asin"),
        F.col("l_orderkey").cast("string").alias("user_id"),
        ((F.col("l_quantity").cast("int") % 5) + 1).cast("double").alias("rating"),
        F.col("l_shipdate").alias("reviewed_at"),
        epoch_millis(F.col("l_shipdate")).alias("timestamp_ms"))


# ---------------------------------------------------------------------------
# affiliate
# ---------------------------------------------------------------------------
def aff_orders(spark, sf_dir) -> DataFrame:
    """Orders of customers (affiliates) at suppliers (merchants) for parts; each eleventh came without a click."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "F", "paid")
              .when(F.col("o_orderstatus") == "O", "pending").otherwise("refunded"))
    return o.select(
        k.alias("id"), F.col("o_custkey").alias("taoke_id"),
        (k % _size(spark, sf_dir, "supplier") + 1).alias("merchant_id"), (k % _size(spark, sf_dir, "part") + 1).alias("product_id"),
        F.when(k % 11 != 0, k * 8 + 1).alias("click_id"),
        F.floor(F.col("o_totalprice") / 100).cast("decimal(10,2)").alias("order_amount"),
        F.floor(F.col("o_totalprice") / 1000).cast("decimal(10,2)").alias("commission_amount"),
        status.alias("status"), F.col("o_orderdate").alias("ordered_at"))


def aff_clicks(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id")).agg(
        F.min("l_partkey").alias("_part"), F.min("l_suppkey").alias("merchant_id"),
        F.min("l_shipdate").alias("clicked_at"))
    return g.select("id", (F.col("_part") % _size(spark, sf_dir, "customer") + 1).alias("taoke_id"),
                    F.col("_part").alias("content_id"), F.col("_part").alias("product_id"), "merchant_id", "clicked_at")


def aff_contents(spark, sf_dir, last_order=None) -> DataFrame:
    """Contents created over the 40 days up to the last order (``last_order``
    may be passed in when the caller already fetched it)."""
    d = table(spark, sf_dir, "documents")
    if last_order is None:
        last_order = fetch_scalar(table(spark, sf_dir, "orders").select(F.max("o_orderdate")))
    last = ntz_literal(last_order)
    k = F.col("doc_id")
    return d.select(k.alias("id"), (k % _size(spark, sf_dir, "customer") + 1).alias("taoke_id"),
                    (k % _size(spark, sf_dir, "supplier") + 1).alias("merchant_id"),
                    F.col("source").alias("content_type"),
                    F.timestamp_add("DAY", -(k % 40), last).alias("created_at"))


def aff_rules(spark, sf_dir) -> DataFrame:
    """A commission rule for the keys of every order that has an even key, several for some keys."""
    o = aff_orders(spark, sf_dir)
    return o.select(
        "id", "merchant_id", F.when(F.col("id") % 2 == 0, F.col("product_id")).otherwise(F.col("product_id") + 1).alias("product_id"), "taoke_id",
        ((F.col("id") % 20 + 5) / F.lit(100.0)).cast("decimal(5,4)").alias("commission_rate"),
        F.col("ordered_at").cast("date").alias("effective_from"))


def aff_products(spark, sf_dir) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % _size(spark, sf_dir, "supplier") + 1).alias("merchant_id"),
                    F.col("p_name").alias("name"))


def aff_content_products(spark, sf_dir) -> DataFrame:
    """Each content shows two parts."""
    d = table(spark, sf_dir, "documents")
    parts = _size(spark, sf_dir, "part")
    both = F.explode(F.array(F.col("doc_id") % parts + 1, (F.col("doc_id") * 7 + 2) % parts + 1))
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("content_id"), both.alias("product_id"))


def taoke_dim(spark, sf_dir) -> DataFrame:
    """Affiliates: all customers."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))


def merchant_dim(spark, sf_dir) -> DataFrame:
    """Merchants: all suppliers."""
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def last_order_time(spark, sf_dir):
    return fetch_scalar(table(spark, sf_dir, "orders").select(F.max("o_orderdate")))


def aff_as_of(spark, sf_dir, last_order=None):
    """The date of the last order (fetched once; used as a literal)."""
    last_order = last_order_time(spark, sf_dir) if last_order is None else last_order
    return None if last_order is None else last_order.date()


def behavior_as_of(df: DataFrame):
    """The newest event time of a behavior log."""
    return fetch_scalar(df.select(F.max("ts")))


def catalog_as_of(spark, sf_dir):
    """The newest review time."""
    return fetch_scalar(table(spark, sf_dir, "lineitem").select(F.max("l_shipdate")))


# ---------------------------------------------------------------------------
# DuckDB common-table expressions (same meaning as the builders above)
# ---------------------------------------------------------------------------
_ACTION_CASE = ("CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'fav' "
                "WHEN 'signup' THEN 'cart' WHEN 'purchase' THEN 'buy' ELSE event_type END")

CTES: dict[str, str] = {
    "behavior": f"""SELECT user_id*20 + event_id%20 AS user_id,
       user_id//65*10 + CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)%10 AS item_id,
       {_ACTION_CASE} AS action, ts
FROM events""",
    "behavior_dense": f"""SELECT user_id,
       user_id//65*10 + CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)%10 AS item_id,
       {_ACTION_CASE} AS action, ts
FROM events""",
    "behavior_sparse": """SELECT user_id*20 + event_id%20 AS user_id,
       user_id//65*10 + CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)%10 AS item_id,
       CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'fav'
            WHEN 'signup' THEN CASE WHEN event_id%25=0 THEN 'cart' ELSE 'pv' END
            WHEN 'purchase' THEN CASE WHEN event_id%20=0 THEN 'buy' ELSE 'fav' END ELSE event_type END AS action, ts
FROM events""",
    "behavior_raw": f"""SELECT user_id, user_id//65*10 + CAST(regexp_extract(props,'([0-9]+)',1) AS BIGINT)%10 AS item_id,
 CASE WHEN event_id%3=0 THEN CASE event_type WHEN 'view' THEN '1' WHEN 'click' THEN '2'
        WHEN 'signup' THEN '3' WHEN 'purchase' THEN '4' ELSE '9' END
      WHEN event_id%3=1 THEN upper({_ACTION_CASE})
      ELSE {_ACTION_CASE} END AS behavior_type,
 CASE WHEN event_id%2=0 THEN '' ELSE 'g' END AS user_geohash,
 CAST(event_id%50 AS VARCHAR) AS item_category,
 CASE event_id%4 WHEN 0 THEN substring(CAST(ts AS VARCHAR),1,13)
                 WHEN 1 THEN substring(CAST(ts AS VARCHAR),1,19)
                 WHEN 2 THEN substring(CAST(ts AS VARCHAR),1,10) ELSE 'bad' END AS time
FROM events""",
    "items": f"""SELECT CAST(unnest(CASE WHEN p_partkey%5=0 THEN [p_partkey, p_partkey+{UNREVIEWED}] ELSE [p_partkey] END) AS VARCHAR)
   AS parent_asin, p_name AS title,
 CASE WHEN p_partkey%17=0 THEN NULL ELSE CAST(p_partkey%120 AS DOUBLE)+0.99 END AS price,
 CASE WHEN p_partkey%13=0 THEN NULL
      ELSE CAST(1 AS DOUBLE)+CAST(p_size%9 AS DOUBLE)/2 END AS average_rating,
 CAST(p_partkey%60 AS BIGINT) AS rating_number, p_brand AS brand, p_type AS main_category
FROM part""",
    "reviews": """SELECT CAST(l_partkey AS VARCHAR) AS parent_asin, CAST(l_orderkey AS VARCHAR) AS user_id,
       CAST(CAST(l_quantity AS INT)%5+1 AS DOUBLE) AS rating, l_shipdate AS reviewed_at,
       epoch_ms(l_shipdate) AS timestamp_ms
FROM lineitem""",
    "aff_orders": """SELECT o_orderkey AS id, o_custkey AS taoke_id, o_orderkey % (SELECT count(*) FROM supplier) + 1 AS merchant_id,
 o_orderkey % (SELECT count(*) FROM part) + 1 AS product_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderkey * 8 + 1 END AS click_id,
 CAST(floor(o_totalprice/100) AS DECIMAL(10,2)) AS order_amount,
 CAST(floor(o_totalprice/1000) AS DECIMAL(10,2)) AS commission_amount,
 CASE o_orderstatus WHEN 'F' THEN 'paid' WHEN 'O' THEN 'pending' ELSE 'refunded' END AS status,
 o_orderdate AS ordered_at
FROM orders""",
    "aff_clicks": """SELECT l_orderkey*8+l_linenumber AS id, min(l_partkey) % (SELECT count(*) FROM customer) + 1 AS taoke_id,
 min(l_partkey) AS content_id, min(l_partkey) AS product_id,
 min(l_suppkey) AS merchant_id, min(l_shipdate) AS clicked_at
FROM lineitem GROUP BY l_orderkey*8+l_linenumber""",
    "aff_contents": """SELECT doc_id AS id, doc_id % (SELECT count(*) FROM customer) + 1 AS taoke_id,
 doc_id % (SELECT count(*) FROM supplier) + 1 AS merchant_id, source AS content_type,
 (SELECT max(o_orderdate) FROM orders) - (doc_id%40) * INTERVAL '1' DAY AS created_at
FROM documents""",
    "aff_rules": """SELECT id, merchant_id, product_id + id % 2 AS product_id, taoke_id,
 CAST((id%20+5)/100.0 AS DECIMAL(5,4)) AS commission_rate, CAST(ordered_at AS DATE) AS effective_from
FROM aff_orders""",
    "aff_products": """SELECT p_partkey AS id, p_partkey % (SELECT count(*) FROM supplier) + 1 AS merchant_id, p_name AS name
FROM part""",
    "aff_content_products": """SELECT doc_id AS id, doc_id AS content_id,
 unnest([doc_id, doc_id * 7 + 2]) % (SELECT count(*) FROM part) + 1 AS product_id
FROM documents""",
    "taoke_dim": """SELECT c_custkey AS id, c_name AS name FROM customer""",
    "merchant_dim": """SELECT s_suppkey AS id, s_name AS name FROM supplier""",
    "aff_asof": """SELECT CAST(max(o_orderdate) AS DATE) AS as_of FROM orders""",
}


def with_ctes(sql: str, *names: str, extra: tuple[tuple[str, str], ...] = ()) -> str:
    """Prefix ``sql`` with the named binding CTEs, then the ``extra`` (name, body) CTEs."""
    parts = [f"{n} AS (\n{CTES[n]}\n)" for n in names]
    parts += [f"{n} AS (\n{body}\n)" for n, body in extra]
    return ("WITH " + ",\n".join(parts) + "\n" + sql) if parts else sql
