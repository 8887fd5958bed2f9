"""Spark-native analytics over ordered text, dialogue spans and run logs."""
