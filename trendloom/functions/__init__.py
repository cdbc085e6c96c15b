"""Part of trendloom."""
