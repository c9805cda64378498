"""Customer-retention analytics on Spark: clean, derive features, score, decide, explain."""

__version__ = "0.1.0"
