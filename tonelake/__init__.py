"""tonelake: a PySpark-native engine for listening experiments and other item-rating studies."""

__version__ = "0.1.0"
