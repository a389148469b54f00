"""Operators for large training-text corpora.

Nothing else in the library imports this subpackage.  Every operator takes and
returns DataFrames; ``queries.py`` binds each one to its fixed query.
"""
