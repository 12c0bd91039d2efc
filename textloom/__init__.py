"""textloom: a Spark-native engine for paired text corpora and training data."""
