"""Recording analytics on Spark: time alignment, transform trees, episodes, metrics and datasets."""
