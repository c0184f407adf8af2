"""tesela: a Spark-native engine for scientometric and bibliographic analytics."""

__version__ = "0.1.0"
