"""Spark-native analytics over event logs (process mining) as DataFrame plans."""
