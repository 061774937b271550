"""Operators for preparing language-model training data, on Spark DataFrames.

One module per operator; ``queries`` binds each of them to the tables of a data folder.
Nothing outside this subpackage imports it.
"""
