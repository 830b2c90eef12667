"""quillstone: a PySpark-native engine for document, vector and catalog analytics."""

__version__ = "0.1.0"
