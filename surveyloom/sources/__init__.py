"""Named datasets, incremental ingest to Parquet, checks, and result sinks."""
