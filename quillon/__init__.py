"""A PySpark-native analytics engine: scene-graph evidence to scored benchmark reports."""
