"""Operators for preparing large text corpora for model training.

Nothing outside this subpackage imports it.  Every operator lives in its own
module with a general interface; ``queries`` holds the thin registered queries.
"""
