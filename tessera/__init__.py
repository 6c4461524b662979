"""Tessera: interval, sequence, state-model and tree analytics on Spark DataFrames."""

__version__ = "0.1.0"
