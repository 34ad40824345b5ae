"""Spark-native evaluation, cleaning and auditing of what automated agents read and do."""
