"""mnemospark: Spark-first operators over the data an AI agent accumulates."""

__version__ = "0.1.0"
