"""functions of newsloom."""
