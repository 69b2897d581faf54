"""Training-data operators over documents, pages and benchmark tables.

Nothing outside this subpackage imports it; ``registry`` holds its queries and
their SQL.
"""
