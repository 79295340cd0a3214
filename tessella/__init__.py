"""Map tiles, point clusters and incremental updates as Spark DataFrame plans."""
