"""Lead-data analytics on Spark: landed business directories, crawled pages and post archives as DataFrames."""
