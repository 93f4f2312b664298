"""lotwright: land-assembly analytics and corpus preparation on Spark DataFrames."""
