"""A PySpark-native analytics engine for a hierarchical triangular grid of the globe."""
