"""Spark-native word-vector analytics: vocabulary, co-occurrence, training, evaluation."""
