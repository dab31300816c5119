"""Operators for preparing large text corpora.

Nothing else in the library imports this subpackage.  Each operator lives in
a module of its own; ``queries`` holds the registered queries and their SQL.
"""
