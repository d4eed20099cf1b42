"""Training-data operators: ten corpus-scale operators and the queries that apply them.

Nothing outside this subpackage imports it.
"""
