"""Operators for preparing language-model training corpora.

Nothing else in the library imports this subpackage.  ``queries`` holds the
thin registered queries, ``oracle`` their DuckDB counterparts, and every other
module one operator with its own general interface.
"""
