"""The incremental crawl."""
