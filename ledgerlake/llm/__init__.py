"""Operators of a training-data pipeline over documents, pages and benchmark items.

Each module holds one operator with its own general interface; ``queries`` registers one thin query
per operator. Nothing outside this package imports it.
"""
