"""Operators for preparing language-model training data.

Each module holds one operator with its own interface; ``queries.py`` binds
them to the driver tables. Nothing outside this folder imports it.
"""
