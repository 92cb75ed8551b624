"""Operators that training-data pipelines need.

Nothing outside this subpackage imports it.
"""
