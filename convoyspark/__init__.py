"""Movement-planning analytics as plain Spark DataFrame functions."""
