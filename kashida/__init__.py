"""A PySpark-native engine for analysing a corpus of structured texts."""
