"""Spark-first analytics for support conversations: threads, retrieval, checks and statistics."""
