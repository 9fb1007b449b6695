"""Species-distribution analytics as plain Spark DataFrame functions."""
