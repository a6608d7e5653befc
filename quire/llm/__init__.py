"""Operators for preparing language-model training data.

Each module holds one operator with its own interface; ``queries`` registers the
``opN_*`` queries.  Nothing outside this subpackage imports it.
"""
