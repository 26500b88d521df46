"""Natural-language and relational analytics compiled to Spark DataFrames."""

__version__ = "0.1.0"
