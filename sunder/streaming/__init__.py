"""Row-local splits of Structured Streaming DataFrames."""
