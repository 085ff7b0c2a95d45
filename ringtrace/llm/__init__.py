"""Operators for building a training corpus from large text tables.

Nothing else in the library imports this subpackage.
"""
