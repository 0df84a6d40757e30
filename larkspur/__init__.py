"""larkspur: a PySpark-native engine for tabular data quality."""
