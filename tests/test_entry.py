import __spark_entry__ as entry_mod
from growthlens.plans.registry import all_queries


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["item_id", "pv", "fav", "cart", "buy", "pv_to_buy_rate"]
    assert df.count() > 0


def test_every_core_query_has_a_callable_and_an_oracle():
    core, found, oracles = all_queries(), entry_mod.queries(), entry_mod.oracle_sql()
    assert len(core) >= 68
    assert set(core) <= set(found) and set(core) <= set(oracles) <= set(found)
    assert all(callable(build) for build in found.values())
