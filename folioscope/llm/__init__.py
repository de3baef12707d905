"""Operators for large-scale training-data pipelines.

Nothing outside this package imports it; ``queries()`` and ``oracle_sql()`` of
:mod:`folioscope.llm.queries` are picked up by ``__spark_entry__`` when the package is present.
"""
