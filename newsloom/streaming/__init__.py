"""streaming of newsloom."""
