"""Operators for building language-model training data.

Nothing outside this package imports it.  ``queries.QUERIES`` and
``queries.ORACLE_SQL`` list what ``__spark_entry__`` registers.
"""
