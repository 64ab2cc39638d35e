"""Pain-point analytics and corpus operators on Spark DataFrames."""
