"""Retrieval experiments on Spark: corpora, indexes, runs, metrics, diagnostics.

Every operator takes and returns DataFrames.  Work that must look at the data
before it can plan (size checks, table writes, model fits) says so in its
docstring; everything else is lazy.
"""

__version__ = "0.1.0"
