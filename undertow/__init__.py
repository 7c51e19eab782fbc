"""undertow: Spark-native analytics for transaction networks."""
