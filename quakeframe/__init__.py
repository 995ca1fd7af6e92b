"""quakeframe: a Spark-native analytics engine for observation catalogs and gridded models."""

__version__ = "0.1.0"
