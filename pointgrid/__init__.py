"""Point, voxel, grid and candidate-graph analytics on Spark DataFrames."""
