"""quillpanel: a PySpark engine for text signals on entity-by-day panels."""

__version__ = "0.1.0"
