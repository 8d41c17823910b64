"""Cohort evidence integration over interaction networks, as Spark DataFrame plans."""

__version__ = "0.1.0"
