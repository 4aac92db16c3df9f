"""Registered ingest / sink queries (#1-#9, #11-#16).

Raw JSON and CSV lines are built from the shared tables (every part, every
line item, every event), with blank, broken, old-format and out-of-vocabulary
lines mixed in by key, so the readers see every path.  The oracle computes the
expected parsed rows straight from the source tables.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from growthlens.functions.columns import category_alias, epoch_millis, parse_price
from growthlens.operators import funnel as FN
from growthlens.plans import bindings as bd
from growthlens.plans.bindings import with_ctes
from growthlens.plans.queries_behavior import _ANCHOR, _E, _SEG, ACTION_NAMES, _funnel_sql, _log_cte, _stage_cte
from growthlens.plans.registry import ints_as_double, register
from growthlens.session import scratch_path
from growthlens.sources import behavior_logs as BL
from growthlens.sources import catalog_lines as CL
from growthlens.sources import sinks as SK

META_CATEGORY = " 3c "
CSV_HEADER = "user_id,item_id,category_id,behavior_type,timestamp"


def _s(c: Column) -> Column:
    return c.cast("string")


# ---------------------------------------------------------------------------
# line fixtures (Spark) and expected rows (DuckDB)
# ---------------------------------------------------------------------------
def meta_lines(spark, sf_dir) -> DataFrame:
    p = bd.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    cats = (F.when(k % 5 == 0, F.lit(', "categories": null')).when(k % 5 == 1, F.lit(""))
            .otherwise(F.concat(F.lit(', "categories": ["'), F.col("p_type"), F.lit('", "'),
                                F.col("p_brand"), F.lit('"]'))))
    price = (F.when(k % 3 == 0, _s(F.col("p_retailprice")))
             .when(k % 3 == 1, F.concat(F.lit('"$'), _s(k), F.lit(","),
                                        F.lpad(_s(k % 1000), 3, "0"), F.lit('.50 - 4"')))
             .otherwise(F.lit("null")))
    rating = _s(F.lit(1.0) + (F.col("p_size") % 9).cast("double") / 2)
    rating = F.when(k % 4 == 0, F.concat(F.lit('"'), rating, F.lit('"'))).otherwise(rating)
    count = F.when(k % 7 == 0, F.concat(F.lit('"'), _s(k % 60), F.lit('"'))).otherwise(_s(k % 60))
    good = F.concat(F.lit('{"parent_asin": "'), _s(k), F.lit('", "title": "'), F.col("p_name"),
                    F.lit('", "main_category": "'), F.col("p_type"), F.lit('"'), cats,
                    F.lit(', "store": "'), F.col("p_brand"), F.lit('", "price": '), price,
                    F.lit(', "average_rating": '), rating, F.lit(', "rating_number": '), count, F.lit("}"))
    value = (F.when(k % 50 == 0, F.lit("   "))
             .when(k % 50 == 1, F.concat(F.lit('{"parent_asin": "'), _s(k), F.lit('", "title": ')))
             .when(k % 50 == 2, F.concat(F.lit('{"title": "'), F.col("p_name"), F.lit('"}')))
             .otherwise(good))
    return p.select(k.alias("line_no"), value.alias("value"))


_META_EXPECTED = """SELECT CAST(p_partkey AS VARCHAR) AS parent_asin, p_name AS title, p_type AS main_category,
  CASE WHEN p_partkey % 5 = 0 THEN 'null' WHEN p_partkey % 5 = 1 THEN '[]'
       ELSE '["' || p_type || '", "' || p_brand || '"]' END AS categories_json,
  p_brand AS store,
  CASE p_partkey % 3 WHEN 0 THEN p_retailprice
       WHEN 1 THEN CAST(p_partkey * 1000 + p_partkey % 1000 AS DOUBLE) + 0.5 ELSE NULL END AS price,
  1.0 + CAST(p_size % 9 AS DOUBLE) / 2 AS average_rating, CAST(p_partkey % 60 AS BIGINT) AS rating_number,
  {category} AS category, p_partkey AS line_no
FROM part WHERE p_partkey % 50 NOT IN (0, 1, 2)"""


def review_lines(spark, sf_dir) -> DataFrame:
    li = bd.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate", "l_returnflag", "l_linestatus")
    v = (F.col("l_orderkey") + F.col("l_linenumber")) % 20
    asin, user = _s(F.col("l_partkey")), _s(F.col("l_orderkey"))
    r = ((F.col("l_quantity").cast("int") % 5) + 1).cast("double")
    ms = epoch_millis(F.col("l_shipdate"))
    secs = F.floor(ms / 1000).cast("bigint")
    title = F.concat(F.lit("line "), _s(F.col("l_linenumber")))
    text = F.concat(F.lit("flag "), F.col("l_returnflag"), F.col("l_linestatus"))
    empty = F.lit("")
    new = F.to_json(F.struct(asin.alias("parent_asin"), user.alias("user_id"), r.alias("rating"),
                             ms.alias("timestamp"), title.alias("title"), text.alias("text")))
    old = F.to_json(F.struct(asin.alias("asin"), user.alias("reviewerID"), r.alias("overall"),
                             secs.alias("unixReviewTime"), title.alias("reviewTitle"),
                             text.alias("reviewText")))
    # empty / zero new-style fields fall back to the old-style ones
    mixed = F.to_json(F.struct(empty.alias("parent_asin"), asin.alias("asin"), empty.alias("user_id"),
                               user.alias("reviewerID"), F.lit(0).alias("rating"), r.alias("overall"),
                               F.lit(0).alias("timestamp"), secs.alias("unixReviewTime"),
                               empty.alias("title"), title.alias("reviewTitle"), text.alias("reviewText")))
    broken = F.concat(F.lit('{"parent_asin": "'), asin, F.lit('", '))
    value = (F.when(v == 0, empty).when(v == 1, broken)
             .when(v == 2, old).when(v == 3, mixed).otherwise(new))
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_no"),
                     value.alias("value"), F.col("l_partkey").alias("_part"))


_REVIEWS_EXPECTED = """SELECT CAST(l_partkey AS VARCHAR) AS parent_asin, CAST(l_orderkey AS VARCHAR) AS user_id,
  CAST(CAST(l_quantity AS INT) % 5 + 1 AS DOUBLE) AS rating,
  CASE WHEN (l_orderkey + l_linenumber) % 20 IN (2, 3) THEN epoch_ms(l_shipdate) // 1000
       ELSE epoch_ms(l_shipdate) END AS "timestamp",
  'line ' || CAST(l_linenumber AS VARCHAR) AS title, 'flag ' || l_returnflag || l_linestatus AS text,
  {category} AS category, l_orderkey * 8 + l_linenumber AS line_no, l_partkey AS _part
FROM lineitem WHERE (l_orderkey + l_linenumber) % 20 NOT IN (0, 1)"""


@register("parse_item_meta", with_ctes(_META_EXPECTED.format(category="'Electronics'"), "items"))
def q_parse_item_meta(spark, sf_dir):
    return CL.parse_item_meta(meta_lines(spark, sf_dir), META_CATEGORY).drop("raw_json")


META_LIMIT, CSV_LIMIT = 137, 211


@register("parse_item_meta_limited", with_ctes(_META_EXPECTED.format(category="'Electronics'").replace(
    "FROM part", f"FROM (SELECT * FROM part WHERE p_partkey % 50 <> 0 ORDER BY p_partkey LIMIT {META_LIMIT})"), "items"))
def q_parse_item_meta_limited(spark, sf_dir):
    """The import limit: the first lines that are not blank, of all lines."""
    return CL.parse_item_meta(meta_lines(spark, sf_dir), META_CATEGORY, meta_limit=META_LIMIT).drop("raw_json")


@register("parse_reviews", with_ctes(
    "SELECT * EXCLUDE (_part) FROM (" + _REVIEWS_EXPECTED.format(category="'All_Beauty'") + ")", "items"))
def q_parse_reviews(spark, sf_dir):
    lines = review_lines(spark, sf_dir).drop("_part")
    return CL.parse_reviews(lines, "All_Beauty").drop("raw_json")


@register("reviews_for_items", with_ctes(
    "SELECT * EXCLUDE (_part) FROM (" + _REVIEWS_EXPECTED.format(category="'Electronics'") + ") r "
    "WHERE r.parent_asin IN (SELECT CAST(p_partkey AS VARCHAR) FROM part WHERE p_partkey % 50 NOT IN (0, 1, 2))",
    "items"))
def q_reviews_for_items(spark, sf_dir):
    items = CL.parse_item_meta(meta_lines(spark, sf_dir), META_CATEGORY)
    lines = review_lines(spark, sf_dir).drop("_part")
    return CL.reviews_for_items(lines, items, META_CATEGORY).drop("raw_json")


def _price_text(k: Column) -> Column:
    return (F.when(k % 6 == 0, F.concat(F.lit("$"), _s(k), F.lit(","), F.lpad(_s(k % 1000), 3, "0"),
                                        F.lit(".50 - 4")))
            .when(k % 6 == 1, F.concat(_s(k % 1000), F.lit("."), F.lpad(_s(k % 100), 2, "0")))
            .when(k % 6 == 2, F.lit("N/A")).when(k % 6 == 3, F.lit(""))
            .when(k % 6 == 4, F.concat(F.lit("from "), _s(k % 97), F.lit(" to "), _s(k % 89))))


@register("parse_price", with_ctes("""SELECT id, raw,
  TRY_CAST(nullif(regexp_extract(replace(raw, ',', ''), '(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE) AS price
FROM (SELECT p_partkey AS id, CASE p_partkey % 6
    WHEN 0 THEN '$' || CAST(p_partkey AS VARCHAR) || ',' || lpad(CAST(p_partkey % 1000 AS VARCHAR), 3, '0') || '.50 - 4'
    WHEN 1 THEN CAST(p_partkey % 1000 AS VARCHAR) || '.' || lpad(CAST(p_partkey % 100 AS VARCHAR), 2, '0')
    WHEN 2 THEN 'N/A' WHEN 3 THEN ''
    WHEN 4 THEN 'from ' || CAST(p_partkey % 97 AS VARCHAR) || ' to ' || CAST(p_partkey % 89 AS VARCHAR)
    END AS raw FROM part)""", "items"))
def q_parse_price(spark, sf_dir):
    p = bd.table(spark, sf_dir, "part")
    raw = _price_text(F.col("p_partkey"))
    return p.select(F.col("p_partkey").alias("id"), raw.alias("raw"), parse_price(raw).alias("price"))


@register("category_alias", with_ctes("""SELECT id, raw, CASE trim(raw) WHEN '3c' THEN 'Electronics'
  WHEN '3C' THEN 'Electronics' WHEN 'electronics' THEN 'Electronics' ELSE trim(raw) END AS category
FROM (SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '3c' WHEN 1 THEN '3C' WHEN 2 THEN ' electronics '
  WHEN 3 THEN 'Electronics' WHEN 4 THEN p_type ELSE '  ' || p_brand || ' ' END AS raw FROM part)""", "items"))
def q_category_alias(spark, sf_dir):
    p = bd.table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    raw = (F.when(k % 6 == 0, F.lit("3c")).when(k % 6 == 1, F.lit("3C"))
           .when(k % 6 == 2, F.lit(" electronics ")).when(k % 6 == 3, F.lit("Electronics"))
           .when(k % 6 == 4, F.col("p_type"))
           .otherwise(F.concat(F.lit("  "), F.col("p_brand"), F.lit(" "))))
    return p.select(k.alias("id"), raw.alias("raw"), category_alias(raw).alias("category"))


@register("category_import_counts", with_ctes("""SELECT category, CAST(sum(i) AS BIGINT) AS items,
  CAST(sum(r) AS BIGINT) AS reviews, GROUPING(category) = 1 AS is_total
FROM (SELECT CASE WHEN CAST(parent_asin AS BIGINT) % 2 = 0 THEN 'All_Beauty' ELSE 'Electronics' END AS category,
             1 AS i, 0 AS r FROM meta_x
      UNION ALL SELECT CASE WHEN _part % 2 = 0 THEN 'All_Beauty' ELSE 'Electronics' END, 0, 1 FROM rev_x)
GROUP BY ROLLUP (category)""", "items",
    extra=(("meta_x", _META_EXPECTED.format(category="''")),
           ("rev_x", _REVIEWS_EXPECTED.format(category="''")))))
def q_category_import_counts(spark, sf_dir):
    ml = meta_lines(spark, sf_dir)
    rl = review_lines(spark, sf_dir)
    items = (CL.parse_item_meta(ml.where(F.col("line_no") % 2 == 0), "All_Beauty")
             .unionByName(CL.parse_item_meta(ml.where(F.col("line_no") % 2 == 1), " electronics ")))
    reviews = (CL.parse_reviews(rl.where(F.col("_part") % 2 == 0).drop("_part"), "All_Beauty")
               .unionByName(CL.parse_reviews(rl.where(F.col("_part") % 2 == 1).drop("_part"), "3C")))
    return CL.category_import_counts(items, reviews)


# ---------------------------------------------------------------------------
# behavior CSV / rebuilds
# ---------------------------------------------------------------------------
def behavior_csv_lines(spark, sf_dir) -> DataFrame:
    ev = bd.table(spark, sf_dir, "events")
    eid = F.col("event_id")
    name = F.coalesce(F.when(F.col("event_type") == "view", "pv").when(F.col("event_type") == "click", "fav")
                      .when(F.col("event_type") == "signup", "cart")
                      .when(F.col("event_type") == "purchase", "buy"), F.col("event_type"))
    code = (F.when(name == "pv", "1").when(name == "fav", "2").when(name == "cart", "3")
            .when(name == "buy", "4").otherwise("9"))
    beh = (F.when(eid % 5 == 0, F.upper(name)).when(eid % 5 == 2, F.concat(F.lit(" "), name, F.lit(" ")))
           .when(eid % 5 == 3, code).otherwise(name))
    secs = _s(F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("ts")))
    ts = (F.when(eid % 7 == 0, F.concat(secs, F.lit(".75"))).when(eid % 7 == 1, F.lit("n/a"))
          .otherwise(secs))
    item = _s(F.regexp_extract(F.col("props"), r"([0-9]+)", 1).cast("bigint") % 10)
    fields = [_s(F.col("user_id")), item, _s(eid % 50), beh]
    quoted = [F.concat(F.lit('"'), c, F.lit('"')) for c in (*fields, ts)]
    value = F.when(eid % 11 == 0, F.concat_ws(",", *fields)).when(eid % 13 == 0, F.concat_ws(",", *quoted)).otherwise(
        F.concat_ws(",", *fields, ts))
    data = ev.select(eid.alias("line_no"), value.alias("value"))
    header = ev.agg(F.lit(-1).cast("bigint").alias("line_no"), F.lit(CSV_HEADER).alias("value"))
    return header.unionByName(data)


_CSV_EXPECTED = """SELECT CAST(user_id AS VARCHAR) AS user_id,
  CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 10 AS VARCHAR) AS item_id,
  CASE event_type WHEN 'view' THEN 'pv' WHEN 'click' THEN 'fav' WHEN 'signup' THEN 'cart' ELSE 'buy' END
    AS behavior,
  epoch_us(ts) // 1000000 AS "timestamp", CAST(event_id % 50 AS VARCHAR) AS category_id
FROM events
WHERE event_type IN ('view', 'click', 'signup', 'purchase') AND event_id % 5 <> 3
  AND event_id % 7 <> 1 AND event_id % 11 <> 0"""


@register("import_behavior_csv_limited", with_ctes(f"{_CSV_EXPECTED} ORDER BY event_id LIMIT {CSV_LIMIT}", "items"))
def q_import_behavior_csv_limited(spark, sf_dir):
    """The import limit: the first imported rows in file order, of all lines."""
    return BL.import_behavior_csv(behavior_csv_lines(spark, sf_dir), limit=CSV_LIMIT)


@register("import_behavior_csv", with_ctes(_CSV_EXPECTED, "items"))
def q_import_behavior_csv(spark, sf_dir):
    return BL.import_behavior_csv(behavior_csv_lines(spark, sf_dir))


def _raw_files(spark, sf_dir) -> list[DataFrame]:
    """Two "files" of the raw log (split by category parity), each with a stray index column."""
    base = bd.behavior_raw(spark, sf_dir)
    return [base.where(F.col("item_category").cast("int") % 2 == r).withColumn("Unnamed: 0", F.lit(0))
            for r in (0, 1)]


_RAW_MAPPED = """SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(item_id AS VARCHAR) AS item_id,
  CASE WHEN trim(behavior_type) IN ('1','2','3','4')
       THEN CASE trim(behavior_type) WHEN '1' THEN 'pv' WHEN '2' THEN 'fav' WHEN '3' THEN 'cart' ELSE 'buy' END
       ELSE behavior_type END AS behavior_type,
  user_geohash, item_category, time FROM behavior_raw"""


@register("union_behavior_files", with_ctes(_RAW_MAPPED, "behavior_raw"))
def q_union_behavior_files(spark, sf_dir):
    return BL.union_behavior_files(_raw_files(spark, sf_dir), nrows_each=None)


#: text layouts of the raw log
_LAYOUTS = "['%Y-%m-%d %H:%M:%S', '%Y-%m-%d %H', '%Y-%m-%d']"
_REBUILD = ("rebuilt", f"""SELECT TRY_CAST(user_id AS BIGINT) AS user_id, TRY_CAST(item_id AS BIGINT) AS item_id,
  coalesce(action_names.name, lower(behavior_type)) AS behavior_type,
  nullif(user_geohash, '') AS user_geohash, TRY_CAST(item_category AS INTEGER) AS item_category,
  try_strptime(time, {_LAYOUTS}) AS "timestamp"
FROM behavior_raw LEFT JOIN {ACTION_NAMES} ON TRY_CAST(behavior_type AS INTEGER) = action_names.code""")


@register("rebuild_user_behavior", with_ctes("SELECT * FROM rebuilt", "behavior_raw", extra=(_REBUILD,)))
def q_rebuild_user_behavior(spark, sf_dir):
    return BL.rebuild_user_behavior(bd.behavior_raw(spark, sf_dir))


@register("parse_event_ts", with_ctes(f"""SELECT user_id, item_id, behavior_type, time,
  try_strptime(time, {_LAYOUTS}) AS ts
FROM behavior_raw""", "behavior_raw"))
def q_parse_event_ts(spark, sf_dir):
    raw = bd.behavior_raw(spark, sf_dir).select("user_id", "item_id", "behavior_type", "time")
    return BL.event_ts(raw, "time")


@register("behavior_distribution", with_ctes(
    "SELECT behavior_type AS action, count(*) AS cnt FROM rebuilt GROUP BY 1", "behavior_raw",
    extra=(_REBUILD,)))
def q_behavior_distribution(spark, sf_dir):
    return BL.behavior_distribution(BL.rebuild_user_behavior(bd.behavior_raw(spark, sf_dir)))


# ---------------------------------------------------------------------------
# table maintenance and sinks
# ---------------------------------------------------------------------------
def _incoming_items(spark, sf_dir) -> DataFrame:
    it = bd.items(spark, sf_dir)
    k = F.col("parent_asin").cast("bigint")
    changed = it.where(k % 4 == 0).withColumn("title", F.concat(F.upper("title"), F.lit(" v2")))
    added = it.where(k % 10 == 0).withColumn("parent_asin", _s(k + 1000000))
    return changed.unionByName(added)


@register("upsert_items", with_ctes("""SELECT * FROM incoming
UNION ALL SELECT * FROM items WHERE parent_asin NOT IN (SELECT parent_asin FROM incoming)""", "items",
    extra=(("incoming", """SELECT parent_asin, upper(title) || ' v2' AS title, price, average_rating,
  rating_number, brand, main_category FROM items WHERE CAST(parent_asin AS BIGINT) % 4 = 0
UNION ALL SELECT CAST(CAST(parent_asin AS BIGINT) + 1000000 AS VARCHAR), title, price, average_rating,
  rating_number, brand, main_category FROM items WHERE CAST(parent_asin AS BIGINT) % 10 = 0"""),)))
def q_upsert_items(spark, sf_dir):
    return SK.upsert_items(bd.items(spark, sf_dir), _incoming_items(spark, sf_dir))


@register("append_reviews", with_ctes("""SELECT parent_asin, user_id, rating, reviewed_at,
  CAST(timestamp_ms AS DOUBLE) AS timestamp_ms FROM reviews
UNION ALL SELECT CAST(l_partkey AS VARCHAR), CAST(l_orderkey AS VARCHAR), CAST(CAST(l_quantity AS INT) % 5 + 1 AS DOUBLE),
  l_shipdate, NULL FROM lineitem WHERE l_partkey % 5 = 0""", "reviews"))
def q_append_reviews(spark, sf_dir):
    li = bd.table(spark, sf_dir, "lineitem")
    batch = li.where(F.col("l_partkey") % 5 == 0).select(
        _s(F.col("l_partkey")).alias("parent_asin"), _s(F.col("l_orderkey")).alias("user_id"),
        ((F.col("l_quantity").cast("int") % 5) + 1).cast("double").alias("rating"),
        F.col("l_shipdate").alias("reviewed_at"))
    return ints_as_double(SK.append_reviews(bd.reviews(spark, sf_dir), batch), "timestamp_ms")


def _sink_path(spark, name: str) -> str:
    """A folder for a query's written table in the shared folder."""
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


@register("export_segment_users_csv", with_ctes(
    "SELECT user_id FROM life WHERE segment = 'warm'", "behavior",
    extra=(_E, _ANCHOR, _SEG)))
def q_export_segment_users_csv(spark, sf_dir):
    path = SK.export_segment_users_csv(spark, bd.behavior(spark, sf_dir), _sink_path(spark, "export"), "warm")
    return SK.read_segment_export(spark, path)


@register("save_funnel_tables", with_ctes(
    "SELECT 0 AS strict, * FROM funnel_loose UNION ALL SELECT 1 AS strict, * FROM funnel_strict",
    "behavior_dense", extra=(_log_cte("behavior_dense"), _stage_cte(),
                             ("funnel_loose", _funnel_sql(False)), ("funnel_strict", _funnel_sql(True)))))
def q_save_funnel_tables(spark, sf_dir):
    stage = FN.user_item_stage(FN.behavior_norm(bd.behavior_dense(spark, sf_dir)))
    SK.save_funnel_tables(spark, stage, _sink_path(spark, "funnel_tables"), mode="both")
    return spark.table("item_funnel_features_both")
