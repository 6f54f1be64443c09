"""siftline: Bayesian mail-classification analytics as Spark DataFrame plans."""

__version__ = "0.1.0"
