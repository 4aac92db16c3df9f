"""Readers and sinks.

* ``catalog_lines`` JSON-lines item metadata and reviews (bounded imports)
* ``behavior_logs`` raw CSV/TSV behavior lines, multi-file unions, typed rebuilds
* ``sinks``         upserts, appends, segment CSV export, funnel tables
* ``funnel_store``  bucketed stage table, refreshed by day
* ``incremental``   behavior files imported once, rejects kept
"""
