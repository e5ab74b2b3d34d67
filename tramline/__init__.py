"""tramline: Spark-native urban mobility analytics."""
