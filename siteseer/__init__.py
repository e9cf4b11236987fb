"""siteseer: CRISPR off-target analytics on Spark DataFrames."""
