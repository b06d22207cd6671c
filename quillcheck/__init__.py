"""quillcheck: a Spark-native audit and data-processing engine for scientific manuscripts."""

__version__ = "0.1.0"
