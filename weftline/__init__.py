"""weftline: Spark-native analytics over text, dialogue, code and event context."""

__version__ = "0.1.0"
