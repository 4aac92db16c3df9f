"""Registered queries on the course of events and tables: sessions, ordered chains, table differences, funnel store, incremental import."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from growthlens.functions.columns import ACTIONS, fetch_scalar
from growthlens.operators import chains, diff, sessions
from growthlens.operators import funnel as FN
from growthlens.plans import bindings as bd
from growthlens.plans.bindings import with_ctes
from growthlens.plans.queries_behavior import _CANON, _STAGE
from growthlens.plans.queries_ingest import _CSV_EXPECTED, behavior_csv_lines
from growthlens.plans.registry import ints_as_double, register
from growthlens.session import scratch_path
from growthlens.sources import funnel_store, incremental


def _scratch(spark, name: str) -> str:
    return scratch_path(spark, f"{name}/{uuid.uuid4().hex}")


# ---------------------------------------------------------------------------
# sessions
# ---------------------------------------------------------------------------
PAUSE_MINUTES = 360
_SESSIONS = (
    ("marked", f"""SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) <= {PAUSE_MINUTES * 60_000_000} THEN 0 ELSE 1 END AS begins
FROM behavior_dense WHERE user_id IS NOT NULL AND ts IS NOT NULL"""),
    ("numbered", "SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session_no FROM marked"),
    ("found", "SELECT user_id, CAST(session_no AS BIGINT) AS session_no, min(epoch_us(ts)) AS started, max(epoch_us(ts)) AS ended, count(*) AS n_events, "
     + ", ".join(f"count(*) FILTER (action = '{a}') AS n_{a}, min(epoch_us(ts)) FILTER (action = '{a}') AS t_{a}" for a in ACTIONS)
     + " FROM numbered GROUP BY user_id, session_no"))


def _sessions(spark, sf_dir):
    return sessions.sessions(bd.behavior_dense(spark, sf_dir), PAUSE_MINUTES)


def _as_micros(df, *names):
    return df.withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in names})


@register("behavior_sessions", with_ctes(
    "SELECT * REPLACE (" + ", ".join(f"CAST(t_{a} AS DOUBLE) AS t_{a}" for a in ACTIONS) + ") FROM found", "behavior_dense", extra=_SESSIONS))
def q_behavior_sessions(spark, sf_dir):
    times = [f"t_{a}" for a in ACTIONS]
    return ints_as_double(_as_micros(_sessions(spark, sf_dir), "started", "ended", *times), *times)


@register("session_step_rates", with_ctes("""SELECT CAST(CAST(make_timestamp(started) AS DATE) AS VARCHAR) AS day, count(*) AS sessions, CAST(sum(n_events) AS BIGINT) AS events,
  count(*) FILTER (n_events = 1) AS single_event, CAST(sum(ended - started) AS DOUBLE) / count(*) / 60000000 AS avg_minutes,
  count(t_pv) AS pv, count(*) FILTER (t_fav >= t_pv) AS fav, count(*) FILTER (t_fav >= t_pv AND t_cart >= t_fav) AS cart,
  count(*) FILTER (t_fav >= t_pv AND t_cart >= t_fav AND t_buy >= t_cart) AS buy,
  count(*) FILTER (t_fav >= t_pv) / nullif(count(t_pv), 0) AS pv_to_fav,
  count(*) FILTER (t_fav >= t_pv AND t_cart >= t_fav) / nullif(count(*) FILTER (t_fav >= t_pv), 0) AS fav_to_cart,
  count(*) FILTER (t_fav >= t_pv AND t_cart >= t_fav AND t_buy >= t_cart) / nullif(count(*) FILTER (t_fav >= t_pv AND t_cart >= t_fav), 0) AS cart_to_buy
FROM found GROUP BY 1""", "behavior_dense", extra=_SESSIONS))
def q_session_step_rates(spark, sf_dir):
    return sessions.session_step_rates(_sessions(spark, sf_dir))


# ---------------------------------------------------------------------------
# ordered chains
# ---------------------------------------------------------------------------
def _next(before: str, action: str) -> tuple[str, str]:
    return (action, f"""SELECT b.user_id, b.item_id, min(b.ts) AS t FROM behavior_dense b JOIN "{before}" p ON b.user_id = p.user_id AND b.item_id = p.item_id AND b.ts > p.t
WHERE b.action = '{action}' GROUP BY b.user_id, b.item_id""")


_CHAINS = (
    ("pairs", f"SELECT DISTINCT user_id, item_id FROM behavior_dense WHERE action IN {ACTIONS}"),
    ("pv", "SELECT user_id, item_id, min(ts) AS t FROM behavior_dense WHERE action = 'pv' GROUP BY user_id, item_id"),
    *(_next(a, b) for a, b in zip(ACTIONS, ACTIONS[1:])),
    ("chains", "SELECT user_id, item_id, " + " + ".join(f"CAST({a}.t IS NOT NULL AS INTEGER)" for a in ACTIONS) + " AS depth, "
     + ", ".join(f"CAST(epoch_us({a}.t) AS DOUBLE) AS t_{a}" for a in ACTIONS) + " FROM pairs "
     + " ".join(f"LEFT JOIN {a} USING (user_id, item_id)" for a in ACTIONS)))


def _chains(spark, sf_dir):
    return chains.longest_chains(bd.behavior_dense(spark, sf_dir))


@register("longest_chains", with_ctes("SELECT * FROM chains", "behavior_dense", extra=_CHAINS))
def q_longest_chains(spark, sf_dir):
    times = [f"t_{a}" for a in ACTIONS]
    return ints_as_double(_as_micros(_chains(spark, sf_dir), *times), *times)


@register("item_chain_funnel", with_ctes(
    "SELECT item_id, " + ", ".join(f"count(t_{a}) AS {a}" for a in ACTIONS) + ", "
    + ", ".join(f"count(t_{b}) / nullif(count(t_{a}), 0) AS {a}_to_{b}" for a, b in zip(ACTIONS, ACTIONS[1:])) + " FROM chains GROUP BY item_id",
    "behavior_dense", extra=_CHAINS))
def q_item_chain_funnel(spark, sf_dir):
    return chains.item_chain_funnel(_chains(spark, sf_dir))


# ---------------------------------------------------------------------------
# table differences
# ---------------------------------------------------------------------------
_AFTER = ("after_items", """SELECT * EXCLUDE (copy) FROM (SELECT parent_asin, title, CASE WHEN rating_number % 7 = 0 THEN price + 1 ELSE price END AS price, average_rating, rating_number,
  CASE WHEN rating_number % 11 = 0 THEN NULL ELSE brand END AS brand, main_category,
  unnest(range(CASE WHEN rating_number % 9 = 0 THEN 0 WHEN rating_number % 10 = 0 THEN 2 ELSE 1 END)) AS copy FROM items)""")
_DIFF = (_AFTER, ("gone", "SELECT * FROM items EXCEPT ALL SELECT * FROM after_items"), ("came", "SELECT * FROM after_items EXCEPT ALL SELECT * FROM items"),
         ("differing", "SELECT 'removed' AS change, count(*) AS copies, * FROM gone GROUP BY ALL UNION ALL SELECT 'added', count(*), * FROM came GROUP BY ALL"))


def after_items(items):
    """The catalog a little later: some items gone, some twice, some with another price or no brand."""
    k = F.col("rating_number")
    copies = F.when(k % 9 == 0, 0).when(k % 10 == 0, 2).otherwise(1)
    changed = items.withColumns({"price": F.when(k % 7 == 0, F.col("price") + 1).otherwise(F.col("price")), "brand": F.when(k % 11 != 0, F.col("brand"))})
    return changed.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), copies))).drop("_copy")


@register("table_diff", with_ctes("SELECT * FROM differing", "items", extra=_DIFF))
def q_table_diff(spark, sf_dir):
    before = bd.items(spark, sf_dir)
    return diff.table_diff(before, after_items(before))


_NAMES = ("title", "price", "average_rating", "rating_number", "brand", "main_category")


@register("keyed_diff", with_ctes(
    "SELECT parent_asin, CASE WHEN n_removed = 0 THEN 'added' WHEN n_added = 0 THEN 'removed' ELSE 'changed' END AS change, n_removed, n_added, "
    "CASE WHEN n_removed = 1 AND n_added = 1 THEN array_to_string([x FOR x IN [" + ", ".join(f"CASE WHEN old_{n} IS DISTINCT FROM new_{n} THEN '{n}' END" for n in _NAMES)
    + "] IF x IS NOT NULL], '|') END AS columns FROM (SELECT coalesce(o.parent_asin, n.parent_asin) AS parent_asin, "
    "coalesce(o.c, 0) AS n_removed, coalesce(n.c, 0) AS n_added, " + ", ".join(f"o.{n} AS old_{n}, n.{n} AS new_{n}" for n in _NAMES)
    + " FROM (SELECT parent_asin, count(*) AS c, " + ", ".join(f"max({n}) AS {n}" for n in _NAMES) + " FROM gone GROUP BY parent_asin) o "
    "FULL JOIN (SELECT parent_asin, count(*) AS c, " + ", ".join(f"max({n}) AS {n}" for n in _NAMES) + " FROM came GROUP BY parent_asin) n ON o.parent_asin = n.parent_asin)",
    "items", extra=_DIFF))
def q_keyed_diff(spark, sf_dir):
    before = bd.items(spark, sf_dir)
    return diff.keyed_diff(before, after_items(before), ["parent_asin"])


# ---------------------------------------------------------------------------
# funnel store
# ---------------------------------------------------------------------------
@register("funnel_store", with_ctes(
    "SELECT user_id, item_id, " + ", ".join(f"CAST({a}_ts AS DOUBLE) AS {a}_ts" for a in ACTIONS) + " FROM first_times", "behavior_dense", extra=(_CANON, _STAGE)))
def q_funnel_store(spark, sf_dir):
    """A store of the log as it was before its last week came in, refreshed for that week, read as stages."""
    norm = FN.behavior_norm(bd.behavior_dense(spark, sf_dir))
    last = fetch_scalar(norm.select(F.date_from_unix_date(F.floor(F.max("ts") / 86_400).cast("int"))))
    name, days = f"funnel_stage_{uuid.uuid4().hex}", [] if last is None else fetch_scalar(
        spark.range(1).select(F.sequence(F.date_sub(F.lit(last), 6), F.lit(last))))
    late = F.date_from_unix_date(F.floor(F.col("ts") / 86_400).cast("int")).isin(days)
    # one event in three of that week had come in by then
    funnel_store.create_store(norm.where(~late | (F.col("ts") % 3 == 0)), name, _scratch(spark, "funnel_store"), buckets=8)
    funnel_store.refresh_days(norm, name, days)
    return ints_as_double(funnel_store.stage_of(spark, name), *(f"{a}_ts" for a in ACTIONS))


# ---------------------------------------------------------------------------
# incremental import
# ---------------------------------------------------------------------------
def _imported(spark, sf_dir) -> str:
    """A store after two runs, the second of which finds the files of the first again, and a third that finds nothing new."""
    folder, store = _scratch(spark, "incoming"), _scratch(spark, "imported")
    lines = behavior_csv_lines(spark, sf_dir)
    for part in (F.col("line_no") % 3 == 0, F.col("line_no") % 3 != 0, None):
        if part is not None:
            lines.where(part).select("value").write.mode("append").text(folder)
        incremental.import_new_files(spark, folder, store)
    return store


@register("incremental_import", with_ctes(_CSV_EXPECTED, "items"))
def q_incremental_import(spark, sf_dir):
    return incremental.accepted_rows(spark, _imported(spark, sf_dir))


@register("import_rejects", f"""SELECT reason, count(*) AS lines FROM (SELECT CASE WHEN event_id % 11 = 0 THEN '{incremental.FEW_FIELDS}'
  WHEN event_id % 7 = 1 THEN '{incremental.BAD_TIME}'
  WHEN event_type NOT IN ('view', 'click', 'signup', 'purchase') OR event_id % 5 = 3 THEN '{incremental.BAD_ACTION}' END AS reason
FROM events) WHERE reason IS NOT NULL GROUP BY reason""")
def q_import_rejects(spark, sf_dir):
    return incremental.rejected_lines(spark, _imported(spark, sf_dir)).groupBy("reason").agg(F.count("*").alias("lines"))
