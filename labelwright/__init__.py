"""labelwright: record verification and text-corpus operators on PySpark."""

__version__ = "0.1.0"
