"""Operators for preparing language-model training data.

Every operator takes and returns DataFrames, ignores columns it does not know, and works on whole
texts.  Nothing else in the library imports this subpackage.
"""
