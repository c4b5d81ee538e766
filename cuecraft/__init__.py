"""Spark-native analytics for timed transcripts, clips and channels."""
