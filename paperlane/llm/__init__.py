"""Operators for preparing training text at large scale.

Nothing outside this subpackage imports it.
"""
