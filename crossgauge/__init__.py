"""A Spark-native engine for cross-lingual classification diagnostics."""
