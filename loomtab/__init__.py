"""loomtab: tabular iteration, drift and training-data operators written as Spark DataFrame plans."""

__version__ = "0.1.0"
