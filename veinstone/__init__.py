"""Veinstone: structural analytics over code, text and event corpora on Spark DataFrames."""

__version__ = "0.1.0"
