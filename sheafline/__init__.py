"""sheafline: a Spark-native document and table conversion engine."""

__version__ = "0.1.0"
