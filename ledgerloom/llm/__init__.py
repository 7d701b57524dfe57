"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage; ``queries.py`` here lists
the queries and SQL that ``__spark_entry__.py`` adds when it is installed.
"""
