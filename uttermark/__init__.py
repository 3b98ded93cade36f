"""uttermark: analytics over labelled utterance corpora, written for Spark.

Everything takes and returns DataFrames (or Columns); nothing here collects
rows to the driver.  See README.md for the map of operators.
"""
