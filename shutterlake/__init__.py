"""Spark-native analytics for very large media catalogs, written as DataFrame and SQL operators."""
