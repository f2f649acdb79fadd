"""lontar: a PySpark-native engine for curating and evaluating legal-term corpora."""

__version__ = "0.1.0"
