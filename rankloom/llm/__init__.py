"""Training-data operators: filtering, deduplication, tokenisation, packing and search.

Nothing outside this subpackage imports it; ``registry`` holds its queries and SQL.
"""
