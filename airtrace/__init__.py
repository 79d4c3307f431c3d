"""Flight, controller and radio analytics on Spark DataFrames."""
