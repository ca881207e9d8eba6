"""Spark-native analytics for number-plate reading, its telemetry and training corpora."""
