"""Operators of a training-data pipeline.

One module per operator; ``queries.py`` registers the ``opN_*`` queries and
their SQL twins. Nothing outside this package imports it.
"""
