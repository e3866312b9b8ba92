"""An ordered, index-aware analytics engine on Spark DataFrames."""
