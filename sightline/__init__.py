"""sightline: a Spark-native engine for multi-camera observation tables."""

__version__ = "0.1.0"
