"""Spark-native analytics for natural-language-to-temporal-logic benchmarks."""
