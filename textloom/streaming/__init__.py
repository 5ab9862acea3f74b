"""Row-local chains on streams."""
