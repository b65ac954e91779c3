"""volspark: a Spark-native engine for volumetric imaging tables and the data work around them."""

__all__ = ["__version__"]
__version__ = "0.1.0"
