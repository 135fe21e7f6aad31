"""Sources: stored graph tables and source-file trees."""
