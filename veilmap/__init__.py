"""veilmap: access-aware map analytics on Spark DataFrames.

Every figure is computed from the records that the asking viewer may see.
"""
