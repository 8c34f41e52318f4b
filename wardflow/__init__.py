"""Emergency-department flow analytics as plain Spark DataFrame functions."""
