"""PySpark-native analytics for corpora of short texts."""
