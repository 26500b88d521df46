"""From a relational plan to DataFrames."""
