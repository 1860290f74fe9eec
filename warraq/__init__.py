"""warraq: a PySpark-native engine for evaluating and preparing text transcriptions."""
