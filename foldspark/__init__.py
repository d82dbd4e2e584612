"""A PySpark-native analytics engine for entity-structured scientific data."""
