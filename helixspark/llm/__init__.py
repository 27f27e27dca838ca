"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Every operator takes DataFrames and the names of the columns that it needs, selects only those (further columns, also ones
with the names of its own results, never clash) and gives a DataFrame back. Intermediate tables go to the folder that
``spark.checkpoint.dir`` names.
"""
