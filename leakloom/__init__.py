"""Finding leaked credentials in large bodies of text, on Spark."""
__version__ = "0.2.0"
