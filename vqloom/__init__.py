"""vqloom: vector-quantisation analytics over embedding rasters, expressed as Spark DataFrames."""
