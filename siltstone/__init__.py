"""siltstone: a Spark-native analytics engine for source-code corpora and training text."""
