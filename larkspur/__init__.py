"""Spark-native analytics for labelled annotations, detection streams and study sessions."""
