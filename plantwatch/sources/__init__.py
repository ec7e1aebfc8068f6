"""Bus topics, lake tables and serving measurements."""
