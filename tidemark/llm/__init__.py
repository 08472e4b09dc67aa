"""Training-data operators. Nothing outside this subpackage imports it.

``queries()`` and ``oracle_sql()`` in :mod:`tidemark.llm.registry` list the thin contract queries.
"""
