"""Spark-first analytics over coded symbol sequences, their vector spaces and the text around them."""
