"""Row logic in plain Python, without Spark; the vectorized functions call it."""
