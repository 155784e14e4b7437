"""corpusforge: web-corpus preparation and model evaluation as Spark DataFrame jobs."""

__version__ = "0.1.0"
