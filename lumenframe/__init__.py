"""Spark-native engine for time-stamped multimodal evidence."""
