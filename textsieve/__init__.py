"""Spark-native toolkit for building, auditing, scoring and explaining labelled text corpora."""
