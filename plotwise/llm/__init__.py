"""Operators that prepare language-model training data, and the queries built on them.

Each module holds one operator with its own interface; ``registry`` lists the queries and their SQL.
"""
