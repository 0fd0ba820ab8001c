"""Spark-native analytics for sequencing reads, intervals, pileups and ordered streams."""
