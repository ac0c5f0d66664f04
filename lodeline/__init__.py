"""Lodeline: a PySpark-native engine for building, querying and auditing text knowledge bases."""
