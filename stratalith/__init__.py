"""A Spark-native engine for knowledge corpora and content packs."""
