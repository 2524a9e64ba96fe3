"""PySpark-native analytics over evidence-anchored text corpora."""
