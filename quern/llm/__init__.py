"""Operators for preparing training data at corpus scale.

Each module holds one operator; ``queries`` holds the thin registered queries.
Nothing outside this subpackage imports it.
"""
