"""Skein: a PySpark-native engine for workflow analytics and data processing."""
