"""Route analytics on Spark: networks, travel-time functions and workloads as DataFrames."""
