"""A Spark-native engine for tabular learning, evaluation and training-data preparation."""
