"""recordlab: compare, sample and generate datasets with PySpark DataFrames."""

__version__ = "0.1.0"
