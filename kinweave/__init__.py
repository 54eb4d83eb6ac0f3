"""Related-item discovery over tables, as DataFrame, SQL and Structured Streaming operations."""
