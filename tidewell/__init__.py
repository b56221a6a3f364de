"""Event analytics on Spark: ingest, resolve, deduplicate, browse and report events from many overlapping sources."""
