"""silvaspark: forest-inventory analytics (rasters, crowns, point clouds) as Spark DataFrames."""
