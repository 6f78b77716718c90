"""Operators of a large-scale text-corpus pipeline, written for Spark.

Nothing else in the library imports this package.  Every module states, in its
docstring, the method it uses, what it does with nulls, empty and very long
texts, ties, repeated rows and empty tables, and what is bounded by what.
"""
