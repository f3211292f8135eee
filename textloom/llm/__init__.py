"""Operators of a training-data pipeline: ten corpus operators and their queries.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
