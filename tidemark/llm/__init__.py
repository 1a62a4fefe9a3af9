"""Operators of a training-data pipeline: filtering, deduplication, mixing, sharding, packing and token output.

Nothing outside this folder imports it.  Every operator takes a DataFrame and the names of its id and text
columns, selects just the columns it needs (extra columns of any name do no harm) and returns a DataFrame.
"""
