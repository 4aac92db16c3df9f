"""growthlens: growth analytics for commerce data as Spark DataFrame operators.

Every operator takes DataFrames (plus plain parameters) and returns a lazy
DataFrame built from Spark's own expressions, computed for all users, items
or entities at once.  Sub-packages:

* ``functions``  column-level helpers (tolerant parsing, action codes, ratios)
* ``sources``    raw line / CSV readers and table sinks
* ``operators``  behavior, funnel, recommender, affiliate and rule operators
* ``plans``      composite outputs (dashboard) and the test-table bindings
"""

from growthlens.session import checkpoint_dir, get_spark, scale_profile

__all__ = ["get_spark", "checkpoint_dir", "scale_profile"]
