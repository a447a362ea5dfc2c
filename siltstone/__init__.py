"""siltstone: site-content and search-position analytics as Spark DataFrame programs."""
