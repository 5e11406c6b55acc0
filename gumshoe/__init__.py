"""gumshoe: find problems in tables and source files with Spark DataFrames."""
