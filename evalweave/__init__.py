"""Evaluation analytics and corpus preparation as plain Spark DataFrame operators."""
