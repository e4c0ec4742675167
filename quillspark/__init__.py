"""A PySpark-native engine for document-catalog sync, routing, ranking, views and full text."""
