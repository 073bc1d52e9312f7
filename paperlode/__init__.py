"""Document analytics, fact extraction and retrieval as Spark plans."""

__version__ = "0.1.0"
