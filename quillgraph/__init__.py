"""Spark-native relational graph engine."""
