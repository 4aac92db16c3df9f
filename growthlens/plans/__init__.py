"""Composite outputs and the registered queries.

* ``dashboard``  the merchant dashboard (one tall frame over several operators)
* ``bindings``   test tables -> canonical operator inputs (Spark and DuckDB forms)
* ``registry``   one registered query per operator with its oracle SQL
  (filled by ``queries_behavior``, ``queries_catalog``, ``queries_affiliate``,
  ``queries_ingest``)
"""
