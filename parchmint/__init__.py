"""Document analytics on Spark: search, repository, text analytics, images, files and streams."""
