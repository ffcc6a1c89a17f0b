"""Link analysis and document clustering on Spark DataFrames."""
