"""A PySpark-native engine for retrieval over text and code, its evaluation and telemetry."""
