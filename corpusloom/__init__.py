"""Document-corpus analytics on Spark: ingest, index, search, policy and evaluation as DataFrame plans."""

__version__ = "0.1.0"
