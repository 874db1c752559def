"""Statement-to-ledger analytics on PySpark: declarative operators over statement tables."""

__version__ = "0.1.0"
