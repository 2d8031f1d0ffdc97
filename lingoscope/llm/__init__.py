"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes a DataFrame
and the names of the columns it needs, selects just these first (so further
columns, whatever their names, cannot clash), and returns a DataFrame.
"""
