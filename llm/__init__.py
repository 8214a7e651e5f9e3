"""Operators of a training-data pipeline, each a Spark job over ``documents``-like tables.

Nothing else in the library imports this package. ``queries.py`` registers
one query per operator; the modules hold the operators themselves.
"""
