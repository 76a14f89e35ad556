"""Spark-native trajectory curation and commerce evidence."""
