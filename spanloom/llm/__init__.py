"""Operators of a training-data pipeline: tokenizing, deduplication, language, mixing.

Nothing else in the library imports this subpackage. Every operator reads the columns it needs by
name, so other columns of the input never clash with its own.
"""
