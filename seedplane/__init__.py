"""Seedplane: a PySpark-native synthetic-data and masking engine."""
