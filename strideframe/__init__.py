"""A Spark-native engine for location data: map features, trajectories and keyed event streams."""

__version__ = "0.1.0"
