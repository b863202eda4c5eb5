"""Training-data operators: one module per operator, queries in ``queries.py``.

Nothing outside this folder imports it; ``__spark_entry__.py`` adds its queries
only where it can be imported.
"""
