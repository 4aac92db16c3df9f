"""Sessions, ordered chains, table differences, the funnel store and incremental import on hand-made data."""

import collections
import datetime as dt
import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from growthlens.functions.columns import ACTIONS
from growthlens.operators import chains, diff, sessions
from growthlens.sources import funnel_store, incremental

T0 = dt.datetime(2024, 1, 1)
LOG = "user_id long, item_id long, action string, ts timestamp_ntz"


def _at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- sessions -------------------------------------------------------------------------------------
def _brute_sessions(rows, pause):
    out, by_user = {}, collections.defaultdict(list)
    for u, _, a, t in rows:
        if u is not None and t is not None:
            by_user[u].append((t, a))
    for u, events in by_user.items():
        events.sort(key=lambda e: e[0])
        no, last = 0, None
        for t, a in events:
            if last is None or t - last > dt.timedelta(minutes=pause):
                no += 1
                out[u, no] = [t, t, collections.Counter(), {}]
            found = out[u, no]
            found[1] = last = t
            found[2]["n"] += 1
            found[2][a] += 1
            found[3].setdefault(a, t)
    return out


@pytest.mark.parametrize("pause", [1, 30, 500])
def test_sessions_match_a_walk_through_each_users_events(spark, pause):
    rng = random.Random(pause)
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), 1, rng.choice([*ACTIONS, "error", None]), rng.choice([_at(rng.randrange(6000)), _at(rng.randrange(6000)), None])) for _ in range(700)]
    rows += [(9, 1, "pv", _at(0)), (9, 1, "buy", _at(pause)), (9, 1, "pv", _at(2 * pause) + dt.timedelta(microseconds=1))] * 2
    got = {(r.user_id, r.session_no): r for r in sessions.sessions(spark.createDataFrame(rows, LOG), pause).collect()}
    want = _brute_sessions(rows, pause)
    assert set(got) == set(want) and {(9, 1), (9, 2)} <= set(got) and (9, 3) not in got
    for key, (started, ended, n, first) in want.items():
        r = got[key]
        assert (r.started, r.ended, r.n_events) == (started, ended, n["n"])
        assert all(r[f"n_{a}"] == n[a] and r[f"t_{a}"] == first.get(a) for a in ACTIONS)


def test_session_rates_count_steps_in_order(spark):
    rows = [(1, 1, "pv", _at(0)), (1, 1, "fav", _at(0)), (1, 1, "cart", _at(5)),  # three steps, the second at the time of the first
            (2, 1, "fav", _at(0)), (2, 1, "pv", _at(1)), (2, 1, "buy", _at(2)),  # favourite before the view
            (3, 1, "error", _at(0)), (4, 1, "pv", _at(24 * 60))]
    got = {r.day: r for r in sessions.session_step_rates(sessions.sessions(spark.createDataFrame(rows, LOG))).collect()}
    one = got[T0.date()]
    assert (one.sessions, one.events, one.single_event, one.pv, one.fav, one.cart, one.buy) == (3, 7, 1, 2, 1, 1, 0)
    assert (one.pv_to_fav, one.fav_to_cart, one.cart_to_buy, one.avg_minutes) == (0.5, 1.0, 0.0, 7 / 3)
    two = got[T0.date() + dt.timedelta(1)]
    assert (two.sessions, two.pv_to_fav, two.fav_to_cart) == (1, 0.0, None)
    assert sessions.session_step_rates(sessions.sessions(spark.createDataFrame([], LOG))).count() == 0
    with pytest.raises(ValueError):
        sessions.sessions(spark.createDataFrame([], LOG), 0)


def test_a_hot_user_is_reduced_before_the_shuffle(spark):
    log = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).alias("user_id"), F.lit("pv").alias("action"),
                                     F.timestamp_seconds(F.col("id") % 7200).cast("timestamp_ntz").alias("ts"))
    got = sessions.sessions(log, 30)
    hot = got.where("user_id = -1").collect()
    assert [(r.session_no, r.n_events) for r in hot] == [(1, 26_666)]
    # the exchange of the events moves partial sums; the windows work on cells
    plan = _plan(got)
    assert plan.rindex("partial_min(t") > plan.rindex("Exchange")


# --- chains ---------------------------------------------------------------------------------------
def _brute_chain(events):
    """Deepest chain by trying all choices; then, among those, the earliest times step by step."""
    best = ()
    for depth in range(len(ACTIONS), 0, -1):
        options = [[t for a, t in events if a == step] for step in ACTIONS[:depth]]
        found = [c for c in itertools.product(*options) if all(x < y for x, y in zip(c, c[1:]))]
        if found:
            best = min(found)
            break
    return best


@pytest.mark.parametrize("bucket_minutes", [1, 7, 100_000])
def test_chains_match_all_choices(spark, bucket_minutes):
    rng = random.Random(bucket_minutes)
    rows = []
    for item in range(60):
        rows += [(item % 7, item, rng.choice([*ACTIONS, "error"]), _at(rng.randrange(25))) for _ in range(rng.randrange(1, 14))]
    rows += rows[::3] + [(None, 1, "pv", T0), (1, None, "pv", T0), (1, 1, None, T0), (1, 1, "pv", None)]
    got = {(r.user_id, r.item_id): tuple(r[f"t_{a}"] for a in ACTIONS if r[f"t_{a}"] is not None) + (r.depth,)
           for r in chains.longest_chains(spark.createDataFrame(rows, LOG), bucket_seconds=bucket_minutes * 60).collect()}
    by_pair = collections.defaultdict(list)
    for u, i, a, t in rows:
        if None not in (u, i, a, t) and a in ACTIONS:
            by_pair[u, i].append((a, t))
    want = {k: _brute_chain(e) for k, e in by_pair.items()}
    assert got == {k: (*c, len(c)) for k, c in want.items()}
    assert len({len(c) for c in want.values()}) == 5


def test_all_sequences_of_six_events(spark):
    rows, want = [], {}
    for k, seq in enumerate(itertools.product(ACTIONS, repeat=6)):
        rows += [(k, 1, a, _at(m)) for m, a in enumerate(seq)]
        want[k] = len(_brute_chain([(a, m) for m, a in enumerate(seq)]))
    got = chains.longest_chains(spark.createDataFrame(rows, LOG), bucket_seconds=120)
    assert {r.user_id: r.depth for r in got.collect()} == want


def test_chain_funnel_and_edges(spark):
    # bought first, then went through all steps: first times alone would show no purchase after a cart
    rows = [(1, 5, a, _at(m)) for m, a in enumerate(["buy", "pv", "fav", "cart", "buy"])] + [(2, 5, "pv", T0), (3, 5, "buy", T0), (4, 6, "error", T0)]
    found = chains.longest_chains(spark.createDataFrame(rows, LOG))
    assert {r.user_id: r.depth for r in found.collect()} == {1: 4, 2: 1, 3: 0}
    one, = chains.item_chain_funnel(found).collect()
    assert one.asDict() == {"item_id": 5, "pv": 2, "fav": 1, "cart": 1, "buy": 1, "pv_to_fav": 0.5, "fav_to_cart": 1.0, "cart_to_buy": 1.0}
    assert chains.longest_chains(spark.createDataFrame([], LOG)).count() == 0
    two = chains.longest_chains(spark.createDataFrame(rows, LOG), steps=("pv", "buy"))
    assert {r.user_id: r.depth for r in two.collect()} == {1: 2, 2: 1, 3: 0}
    with pytest.raises(ValueError):
        chains.longest_chains(spark.createDataFrame(rows, LOG), steps=("pv", "pv"))


# --- differences ----------------------------------------------------------------------------------
SNAP = "id long, name string, price double, tags array<string>"


def test_diff_is_except_all_both_ways(spark):
    rng = random.Random(5)
    make = lambda: [(rng.choice([1, 2, None]), rng.choice(["a", "b", "", None]), rng.choice([1.0, float("nan"), None, 0.0]),
                     rng.choice([["x"], ["x", None], [], None])) for _ in range(150)]
    before, after = spark.createDataFrame(make(), SNAP), spark.createDataFrame(make(), SNAP)
    got = {(r.change, repr(r[2:])): r.copies for r in diff.table_diff(before, after.select("tags", "price", "name", "id")).collect()}
    want = collections.Counter()
    for change, rows in (("removed", before.exceptAll(after)), ("added", after.exceptAll(before))):
        want.update((change, repr(tuple(r))) for r in rows.collect())
    assert got == want and max(want.values()) > 1
    assert diff.table_diff(before, before).count() == 0
    assert diff.table_diff(spark.createDataFrame([], SNAP), after).agg(F.sum("copies")).first()[0] == 150


def test_diff_tells_nulls_by_their_place(spark):
    a, b = spark.createDataFrame([(1, None), (None, 2)], "x int, y int"), spark.createDataFrame([(None, 1), (2, None)], "x int, y int")
    assert diff.table_diff(a, b).count() == 4
    with pytest.raises(ValueError):
        diff.table_diff(a, b.select("x"))


def test_keyed_diff_names_changed_columns(spark):
    before = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0), (3, "c", None), (4, "d", 4.0), (4, "d", 4.0), (None, "n", 0.0)], "id int, name string, price double")
    after = spark.createDataFrame([(1, "a", 1.0), (2, "B", 2.5), (3, "c", 3.0), (4, "d", 4.0), (5, "e", 5.0), (None, "m", 0.0)], "id int, name string, price double")
    got = {r.id: (r.change, r.n_removed, r.n_added, r.columns) for r in diff.keyed_diff(before, after, ["id"]).collect()}
    assert got == {2: ("changed", 1, 1, ["name", "price"]), 3: ("changed", 1, 1, ["price"]), 4: ("removed", 1, 0, None),
                   5: ("added", 0, 1, None), None: ("changed", 1, 1, ["name"])}


# --- funnel store ---------------------------------------------------------------------------------
NORM = "user_id long, item_id long, action string, ts long"


def test_store_reads_without_exchange_and_refresh_equals_rebuild(spark, tmp_path):
    rng = random.Random(3)
    make = lambda n: [(rng.randrange(9), rng.randrange(5), rng.choice([*ACTIONS, "error"]), rng.randrange(-86_400, 9 * 86_400)) for _ in range(n)]
    old = make(600)
    day = lambda r: (dt.date(1970, 1, 1) + dt.timedelta(r[3] // 86_400))
    touched = [dt.date(1969, 12, 31), dt.date(1970, 1, 4), dt.date(1970, 1, 6), dt.date(1970, 2, 1)]
    # one touched day loses all its events, the others get new ones
    new = [r for r in old if day(r) not in touched] + [r for r in make(900) if day(r) in touched[:2]]
    frame = lambda rows: spark.createDataFrame(rows, NORM)
    content = lambda df: sorted(map(repr, df.collect()))
    funnel_store.create_store(frame(old), "store_refreshed", str(tmp_path / "a"), buckets=4)
    funnel_store.create_store(frame(new), "store_rebuilt", str(tmp_path / "b"), buckets=4)
    kept = {p: os.path.getmtime(p) for p in map(str, (tmp_path / "a").rglob("*.parquet")) if "day=1970-01-05" in p}
    funnel_store.refresh_days(frame(new), "store_refreshed", touched)
    funnel_store.refresh_days(frame(new), "store_refreshed", [])
    assert content(funnel_store.stage_of(spark, "store_refreshed")) == content(funnel_store.stage_of(spark, "store_rebuilt"))
    assert kept and all(os.path.getmtime(p) == m for p, m in kept.items())
    window = dict(first_day="1970-01-03", last_day="1970-01-05")
    part = funnel_store.stage_of(spark, "store_refreshed", **window)
    assert content(part) == content(funnel_store.stage_of(spark, "store_rebuilt", **window)) and part.count() > 0
    assert "Exchange" not in _plan(part) and "PartitionFilters: [isnotnull(day" in _plan(part)
    with pytest.raises(ValueError):
        spark.range(1).write.mode("overwrite").option("path", str(tmp_path / "c")).saveAsTable("store_plain")
        funnel_store.refresh_days(frame(new), "store_plain", touched)
    for name in ("store_refreshed", "store_rebuilt", "store_plain"):
        spark.sql(f"DROP TABLE {name}")


# --- incremental import ---------------------------------------------------------------------------
def test_files_are_imported_once_and_rejects_keep_their_reason(spark, tmp_path):
    folder, store, whole = tmp_path / "in", str(tmp_path / "store"), str(tmp_path / "whole")
    folder.mkdir()
    (folder / "one.csv").write_text('user_id,item_id,category_id,behavior_type,timestamp\n1,2,3,PV,10.9\n"4","5",,buy,11\n\n1,2,3,pv\n')
    incremental.import_new_files(spark, str(folder), store)
    assert incremental.accepted_rows(spark, store).count() == 2
    (folder / "two.csv").write_text("1,2,3,pv,n/a\n1,2,3,look,5\n,2,3,pv,5\n7,8,9, fav ,12\n1,2,3,pv,NaN\n")
    (folder / "empty.csv").write_text("")
    incremental.import_new_files(spark, str(folder), store, max_files=1)
    incremental.import_new_files(spark, str(folder), store)
    incremental.import_new_files(spark, str(folder), whole)
    rows = lambda df: sorted(map(repr, df.collect()))
    good = [tuple(r) for r in incremental.accepted_rows(spark, store).orderBy("timestamp").collect()]
    assert good == [("1", "2", "pv", 10, "3"), ("4", "5", "buy", 11, ""), ("7", "8", "fav", 12, "9")]
    bad = {r.value: r.reason for r in incremental.rejected_lines(spark, store).collect()}
    assert bad == {"1,2,3,pv": incremental.FEW_FIELDS, "1,2,3,pv,n/a": incremental.BAD_TIME, "1,2,3,pv,NaN": incremental.BAD_TIME,
                   "1,2,3,look,5": incremental.BAD_ACTION, ",2,3,pv,5": incremental.NO_ID}
    assert rows(incremental.accepted_rows(spark, whole)) == rows(incremental.accepted_rows(spark, store))
    assert rows(incremental.rejected_lines(spark, whole)) == rows(incremental.rejected_lines(spark, store))
