"""tarnmill: crawl-snapshot and access-log analytics on PySpark."""
