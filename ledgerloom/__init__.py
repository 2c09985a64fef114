"""ledgerloom: a PySpark-native engine for located evidence, fact ledgers and corpus preparation."""

__version__ = "0.1.0"
