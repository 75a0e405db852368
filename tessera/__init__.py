"""tessera: a PySpark-native engine for curating training data."""
