"""Operators of a training-data pipeline over document, page and benchmark tables.

Nothing else in the library imports this subpackage. Each module holds one operator with a general interface; the thin
registered queries are in ``queries``.
"""
