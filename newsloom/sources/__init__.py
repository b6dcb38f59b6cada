"""sources of newsloom."""
