"""Folioscope: a PySpark-native document-analytics engine.

Every operator is a function ``(DataFrame..., parameters) -> DataFrame``; nothing in an operator
collects rows that grow with the data.  Sub-packages: ``sources`` (scan, parsers, tables),
``functions`` (column expressions), ``operators`` (search, read, graph, context, index),
``plans`` (the registered queries and their SQL), ``streaming`` (directory watch).
"""

__version__ = "0.1.0"
