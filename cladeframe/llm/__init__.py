"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage; removing the folder
leaves the rest working.  ``queries.py`` holds the registered queries and
``sql.py`` their DuckDB counterparts.
"""
