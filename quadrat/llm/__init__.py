"""Training-data operators: one module per operator, queries in :mod:`quadrat.llm.queries`.

Nothing outside this subpackage imports it.
"""
