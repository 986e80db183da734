"""A Spark-native engine for labelled text corpora."""
