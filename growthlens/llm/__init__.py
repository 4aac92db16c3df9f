"""Training-data operators: one module per operator, plus their registered queries.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
"""
