"""Operators for preparing language-model training data.

Every operator takes a DataFrame, reads only the columns it names and returns
the row id with its own columns: other columns of the input, whatever they are
called, are ignored.  Nothing outside this subpackage imports it.
"""
