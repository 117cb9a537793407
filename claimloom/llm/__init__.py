"""Training-data operators: ten batch operators and the queries that apply them.

Nothing outside this subpackage imports it.
"""
