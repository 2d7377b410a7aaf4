"""Training-data operators: joins, filters, scoring, tokenising, mixing, dedup.

Nothing else in ``itemscope`` imports this sub-package.  ``queries.py`` holds
the registered ``opN_*`` queries and their SQL.
"""
