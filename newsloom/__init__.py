"""newsloom: a PySpark-native engine for news-style content."""
