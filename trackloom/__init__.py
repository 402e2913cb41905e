"""Spark-native analytics of moving objects seen by many sensors."""
