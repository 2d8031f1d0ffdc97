"""Website-quality analytics over crawled pages, as Spark DataFrame jobs."""
