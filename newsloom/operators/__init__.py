"""operators of newsloom."""
