"""Operators of a training-data pipeline (one module each); see README.

Nothing else in the library imports this subpackage.
"""
