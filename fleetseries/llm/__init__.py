"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Each operator is a plain
function on DataFrames in its own module; ``queries`` registers the thin query
of each operator together with its SQL twin where SQL can express it.
"""
