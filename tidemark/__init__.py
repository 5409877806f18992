"""tidemark: provenance-aware time-series analytics as PySpark DataFrame operators."""
