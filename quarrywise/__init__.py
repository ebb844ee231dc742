"""quarrywise: corpus exploration on Spark DataFrames.

The package turns files or tables of text into Parquet index tables and answers
bounded retrieval questions over them.  See README.md for a tour.
"""

__version__ = "0.1.0"
