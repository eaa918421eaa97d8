"""siltloom: a PySpark-native engine that turns crawled pages into a teaser index."""

__all__ = ["__version__"]
__version__ = "0.1.0"
