"""tessera — Spark-native table profiling, target inference and model comparison."""

__version__ = "0.1.0"
