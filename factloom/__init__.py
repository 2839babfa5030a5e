"""factloom: evidence analytics and corpus operators on Spark DataFrames."""
