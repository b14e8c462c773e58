"""Analytics over versioned, reviewable document records, as DataFrame and SQL operators on Spark."""
