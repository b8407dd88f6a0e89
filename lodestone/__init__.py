"""Spark-native high-utility itemset mining."""
