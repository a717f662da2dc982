"""Training-data operators: language id, tokenisation, dedup, filtering, search and formatting.

Nothing outside this subpackage imports it. ``catalog`` holds its registered queries.
"""
