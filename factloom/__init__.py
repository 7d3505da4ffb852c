"""factloom: a Spark-native fact memory and recall engine."""

__version__ = "0.1.0"
