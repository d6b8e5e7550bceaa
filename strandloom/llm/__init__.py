"""Operators for preparing training corpora.

Nothing outside this folder imports it; ``queries`` lists its registered
queries and their SQL.
"""
