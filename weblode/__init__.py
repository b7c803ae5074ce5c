"""weblode: crawl-data analytics expressed as Spark DataFrame and streaming jobs."""
