"""palimp: document-revision analytics on Apache Spark."""
