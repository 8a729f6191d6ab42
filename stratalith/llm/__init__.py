"""Operators for preparing large text and vector corpora for training.

Each module holds one operator with its own general interface.  ``registry`` maps the
query names to thin callables over the shared tables.  Nothing outside this
subpackage imports it.
"""
