"""Operators of a training-data pipeline: near-duplicates, search, scans, formatting, sampling.

Each module holds one operator. ``queries`` registers one query per operator.
Nothing else in the library imports this package.
"""
