"""A PySpark-native engine for the data computations of a replicated blob store and its query services."""
