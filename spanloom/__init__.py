"""Analytics over timed records (words, turns, scenes, marks) on Spark DataFrames."""

__version__ = "0.1.0"
