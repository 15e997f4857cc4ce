"""colloquy: a Spark-native engine for conversational text analytics and retrieval."""

__version__ = "0.1.0"
