"""Text-curation analytics on Spark: declarative operators over paired-text tables."""

__version__ = "0.1.0"
