"""Environmental characterisation and environment-informed prediction on Spark."""

__version__ = "0.1.0"
