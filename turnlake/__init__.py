"""turnlake: a PySpark-native engine for speaker-turn analytics."""

__version__ = "0.1.0"
