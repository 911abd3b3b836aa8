"""Operators for preparing text corpora.

Nothing else in the package imports this folder.  Each module holds one
operator with its own general interface; ``queries`` holds the thin queries
that apply the operators to the driver's tables.
"""
