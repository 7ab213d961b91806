"""Operators that clean, compare, encode and pack page text at corpus scale.

Nothing outside this subpackage imports it; ``queries()`` and ``oracle_sql()`` of
``pagelattice.llm.queries`` are picked up by ``__spark_entry__`` when present.
"""
